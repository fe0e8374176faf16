"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark import contracts as C
from tidemark.functions import expressions as X, ranking
from tidemark.operators import (
    activity, audit, engagement, evaluation, explore, features, identity, lifecycle, model,
    monitoring, outcomes, quality, reports, revenue, routing, scoring, summaries, winback,
)
from tidemark.plans.context import NOW, STORED_DAY, Frames
from tidemark.session import checkpointed, shuffled
from tidemark.sources import bindings as B, sinks, tables
from tidemark.sources.store import KeyTable
from tidemark.streaming import activity as streams, lockout, runner

Query = Callable[[Frames], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain output types: dates and times as text, arrays joined, doubles rounded."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, " | ")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


_frames: dict[tuple[str, str], Frames] = {}


def frames_for(spark: SparkSession, sf_dir: str) -> Frames:
    """The plans of one session and directory, built once; nothing is cached but plans."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames or _frames[key].spark is not spark:
        _frames[key] = Frames(spark, sf_dir)
    return _frames[key]


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: present(QUERIES[name](frames_for(spark, sf_dir)))


# --- scans and sinks ---------------------------------------------------------

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query
def scan_parquet(f: Frames) -> DataFrame:
    tables.register_sources(f.spark, f.sf_dir, RAW)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM raw_{t}" for t in RAW)
    return f.spark.sql(counts)


@query
def scan_projected(f: Frames) -> DataFrame:
    lines = tables.read_table(f.spark, f.sf_dir, "lineitem", ["l_returnflag", "l_quantity"])
    return lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))


@query
def scan_by_mode(f: Frames) -> DataFrame:
    orders = tables.load_table(f.spark, "orders", mode="parquet", directory=f.sf_dir)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query
def scan_jsonl_log(f: Frames) -> DataFrame:
    """Sign-in events written as JSON lines with broken lines in between, read back."""
    path = runner.scratch_dir(f.spark, "auth-log")
    good = f.auth.select(F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event", "username", "outcome", "source", "reason")).alias("value"))
    bad = f.auth.filter(F.col("outcome") == "success").select(F.lit('{"ts": "broken').alias("value"))
    good.unionByName(bad).write.text(path)
    return tables.read_auth_log(f.spark, path).groupBy("outcome", "source").agg(F.count(F.lit(1)).alias("events"))


@query
def sink_parquet(f: Frames) -> DataFrame:
    """The panel written by date, then its last days written again."""
    path = runner.scratch_dir(f.spark, "panel")
    sinks.write_daily_panel(f.panel, path)
    sinks.write_daily_panel(features.member_features_daily(f.t, salt=B.SALT, since="2024-01-26"), path)
    return f.spark.read.parquet(path).groupBy("date_day").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("app_logins_30d").alias("logins"))


@query
def sink_append(f: Frames) -> DataFrame:
    """Audit rows of two router runs appended to one log."""
    path = runner.scratch_dir(f.spark, "audit-log")
    sinks.append_table(routing.audit_rows(_churn(f), run_id="r1", now=NOW), path)
    sinks.append_table(routing.audit_rows(_life_actions(f), run_id="r1", now=NOW, prefix="LA"), path)
    return f.spark.read.parquet(path).groupBy("action_type", "status").agg(F.count(F.lit(1)).alias("rows"))


@query
def concat_append(f: Frames) -> DataFrame:
    """Queue rows of two routers as one queue."""
    rows = _queue(f).unionByName(routing.queue_rows(_life_actions(f), run_id="r1", now=NOW, prefix="LC"))
    return rows.select("action_id", "member_id", "action_type", "status", "created_at", "processed_at")


@query
def union_all_text(f: Frames) -> DataFrame:
    """Occurrences of every text value of the panel."""
    text = ["hashed_member_id", "gender", "home_studio_id", "membership_tier"]
    return f.panel.select(F.explode(F.array(*text)).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))


@query
def union_distinct_pii(f: Frames) -> DataFrame:
    return f.identity.select(F.explode(F.array("name", "email", "phone")).alias("value")).distinct()


def _life_actions(f: Frames) -> DataFrame:
    return routing.route_lifecycle_actions(f.lifecycle, f.identity, f.audit, now=NOW)


def _stage(name: str) -> None:
    def run(f: Frames) -> DataFrame:
        return tables.stage(f.t[name], name)

    run.__name__ = f"stage_{name}"
    query(run)


for _name in C.RAW_TABLES:
    _stage(_name)


@query
def sink_upsert(f: Frames) -> DataFrame:
    """The earlier lifecycle snapshot, kept by key, with current rows replacing theirs."""
    cols = ["hashed_member_id", "stage", "snapshot_date"]
    table = KeyTable(f.spark, runner.scratch_dir(f.spark, "lifecycle"), "hashed_member_id", buckets=16)
    table.create(f.life_before.select(*cols))
    new = checkpointed(f.life_now.filter(F.col("stage") != "engaged").select(*cols))
    table.change(new, lambda rows, new: sinks.upsert(rows, new, ["hashed_member_id"]))
    return table.read()


def _queue(f: Frames) -> DataFrame:
    return routing.queue_rows(_churn(f), run_id="r1", now=NOW)


@query
def sink_status_update(f: Frames) -> DataFrame:
    """Pending calls completed when the member has a later visit."""
    table = KeyTable(f.spark, runner.scratch_dir(f.spark, "queue"), "action_id", buckets=16)
    table.create(_queue(f))
    done = checkpointed(table.read().filter(F.col("status") == "Pending").select(
        "action_id", F.lit("Voicemail Left").alias("outcome"), F.lit("auto").alias("notes")))
    table.change(done, lambda rows, done: sinks.complete_actions(rows, done, f.now)[0])
    updated = table.read()
    return updated.groupBy("action_type", "status").agg(
        F.count(F.lit(1)).alias("actions"), F.count("processed_at").alias("processed"))


@query
def status_update_audit(f: Frames) -> DataFrame:
    pending = _queue(f)
    done = pending.filter(F.col("status") == "Pending").select(
        "action_id", F.lit("No Answer").alias("outcome"), F.lit(None).cast("string").alias("notes"))
    _, rows = sinks.complete_actions(pending, done, f.now)
    return rows.select("member_id", "action_type", "status", "why_score", "message_body")


@query
def encrypt_pii_columns(f: Frames) -> DataFrame:
    """Contacts encrypted and read back."""
    key = "0123456789abcdef"
    cols = ["name", "email", "phone"]
    sealed = sinks.encrypt_pii_columns(f.identity, cols, key)
    return sinks.decrypt_pii_columns(sealed, cols, key)


# --- projections and filters ---------------------------------------------------

@query
def latest_snapshot(f: Frames) -> DataFrame:
    events = f.raw("events").withColumn("day", F.to_date("ts"))
    return scoring.latest_snapshot(events, "day").select("event_id", "user_id", "day", "value")


@query
def risk_tier(f: Frames) -> DataFrame:
    return f.scores


@query
def risk_reasons(f: Frames) -> DataFrame:
    return f.snapshot.select("hashed_member_id", X.reasons_text().alias("reasons"))


@query
def snapshot_reasons(f: Frames) -> DataFrame:
    return f.snapshot.select("hashed_member_id", X.snapshot_reasons().alias("reasons"))


@query
def primary_reason(f: Frames) -> DataFrame:
    return f.snapshot.select("hashed_member_id", X.primary_reason().alias("reason"))


@query
def has_text_intent(f: Frames) -> DataFrame:
    return f.raw("conversations").select(
        "conv_id", "turn",
        X.has_text_intent(F.col("text"), ["thion", "CH", "eau"]).alias("intent"),
        X.has_text_intent(F.col("text")).alias("cancel_intent"))


@query
def parse_risk_tier(f: Frames) -> DataFrame:
    return f.audit.select("audit_id", X.parse_risk_tier(F.col("why_score")).alias("risk_tier"),
                          X.parse_risk_tier(F.col("status")).alias("unmarked"))


@query
def status_filter(f: Frames) -> DataFrame:
    return scoring.status_filter(f.audit, C.DELIVERED).select("audit_id", "status")


@query
def scope_to_studio(f: Frames) -> DataFrame:
    """Reads the stored panel; the studio filter reaches its scan."""
    scoped = scoring.scope_to_studio(
        {"features": f.stored_panel, "identity": f.identity, "scores": f.scores}, "S07")
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("hashed_member_id").alias("members"))
        .select(F.lit(name).alias("frame"), "rows", "members")
        for name, df in scoped.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def member_lookup(f: Frames) -> DataFrame:
    """Reads one bucket of the stored panel."""
    return scoring.member_lookup(f.identity, f.stored_panel, "M0000000007").select(
        "member_id", "name", "date_day", "day_no", "tenure_days", "sessions_attended_30d")


@query
def first_last_days(f: Frames) -> DataFrame:
    return scoring.first_last_days(f.panel).select("hashed_member_id", "date_day", "day_no")


@query
def search_members(f: Frames) -> DataFrame:
    return scoring.search_members(f.identity)


@query
def nan_to_null(f: Frames) -> DataFrame:
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return f.raw("events").select("event_id", X.nan_to_null(v, "int").alias("value"))


# --- daily aggregates and the panel ------------------------------------------------

@query
def daily_sessions(f: Frames) -> DataFrame:
    return activity.daily_sessions(f.t["sessions"])


@query
def daily_transactions(f: Frames) -> DataFrame:
    return activity.daily_transactions(f.t["transactions"])


@query
def daily_app_events(f: Frames) -> DataFrame:
    return activity.daily_app_events(f.t["app_events"])


@query
def daily_chats(f: Frames) -> DataFrame:
    return activity.daily_chats(f.t["ai_coach_chats"])


@query
def daily_emails(f: Frames) -> DataFrame:
    return activity.daily_emails(f.t["email_events"])


@query
def as_of_date(f: Frames) -> DataFrame:
    return activity.as_of_date(f.t)


@query
def member_features_daily(f: Frames) -> DataFrame:
    return f.panel


@query
def member_features_incremental(f: Frames) -> DataFrame:
    """The last days only, from the stored state of the day before and those days of the feeds."""
    return f.daily_run


@query
def member_features_since(f: Frames) -> DataFrame:
    """The last days only, from raw feeds: older activity is folded into the first day needed."""
    return features.member_features_daily(f.t, salt=B.SALT, since="2024-01-26")


@query
def member_state_daily(f: Frames) -> DataFrame:
    """Two daily runs that move the stored state on, and the second day's rows from its state alone."""
    days = [STORED_DAY, "2024-01-26", "2024-01-27"]
    for before, day in zip(days, days[1:]):
        f.store.advance(f.t, before, day)
    return f.store.panel_of(f.t, days[-1])


@query
def member_features_snapshot(f: Frames) -> DataFrame:
    return f.member_days()


@query
def member_features_snapshot_earlier(f: Frames) -> DataFrame:
    return f.member_days(7)


@query
def rolling_sum_7d(f: Frames) -> DataFrame:
    return f.panel.select("hashed_member_id", "date_day", "sessions_booked_7d", "sessions_attended_7d", "app_logins_7d")


@query
def rolling_sum_30d(f: Frames) -> DataFrame:
    return f.panel.groupBy("date_day").agg(
        F.sum("sessions_booked_30d").alias("booked"), F.sum("retail_spend_30d").alias("retail"),
        F.sum("app_logins_30d").alias("logins"), F.sum("emails_opened_30d").alias("opened"))


@query
def last_attended_date(f: Frames) -> DataFrame:
    seen = F.col("days_since_last_session") < C.NEVER_ATTENDED_DAYS
    return f.panel.filter(seen).select(
        "hashed_member_id", "date_day",
        F.date_sub("date_day", F.col("days_since_last_session").cast("int")).alias("last_attended"))


@query
def last_payment_status(f: Frames) -> DataFrame:
    return f.panel.groupBy("date_day").agg(
        X.count_when(F.col("last_recurring_payment_failed")).alias("members_failed"))


@query
def member_identity(f: Frames) -> DataFrame:
    return f.identity


@query
def inactive_members(f: Frames) -> DataFrame:
    """Members without a row in the latest snapshot."""
    return f.identity.join(f.snapshot, "hashed_member_id", "left_anti").select("member_id")


# --- scored reports ------------------------------------------------------------------

@query
def scored_features(f: Frames) -> DataFrame:
    return scoring.scored_features(f.scores, f.snapshot).select(
        "hashed_member_id", "score_date", "churn_probability", "home_studio_id", "monthly_price")


@query
def risk_kpis(f: Frames) -> DataFrame:
    return scoring.risk_kpis(f.scores, f.snapshot)


@query
def risk_distribution(f: Frames) -> DataFrame:
    return scoring.risk_distribution(f.scores)


@query
def risk_histogram(f: Frames) -> DataFrame:
    return scoring.risk_histogram(f.scores)


@query
def studio_risk_breakdown(f: Frames) -> DataFrame:
    return scoring.studio_risk_breakdown(f.scores, f.snapshot)


@query
def top_k_at_risk(f: Frames) -> DataFrame:
    return scoring.top_k_at_risk(f.scores, f.snapshot, f.identity, 20)


@query
def priority_actions(f: Frames) -> DataFrame:
    return scoring.priority_actions(f.scores, f.snapshot, f.identity)


@query
def demo_member_pick(f: Frames) -> DataFrame:
    return scoring.demo_member_pick(f.scores, f.snapshot)


@query
def latest_by_key(f: Frames) -> DataFrame:
    rows = f.raw("events").select("user_id", "event_id", "event_type", "value")
    return scoring.latest_by_key(rows, ["user_id"], "event_id")


@query
def last_n_per_key(f: Frames) -> DataFrame:
    chats = B.chat_domain(f.spark, f.sf_dir)
    return scoring.last_n_per_key(chats, ["member_key"], ["turn"], 8).select(
        "member_key", "turn", "sender", F.length("message_text").alias("n_chars"), "position")


@query
def dedup_first(f: Frames) -> DataFrame:
    """One lifecycle row per member out of several snapshots."""
    return scoring.dedup_first(
        f.life_history, ["hashed_member_id"], [F.desc("snapshot_date")]
    ).select("hashed_member_id", "stage", "snapshot_date")


# --- lifecycle and engagement ----------------------------------------------------------

@query
def lifecycle_stage(f: Frames) -> DataFrame:
    return f.stages(f.snapshot, f.as_of)


@query
def stage_transition(f: Frames) -> DataFrame:
    return f.lifecycle


@query
def stage_transition_days(f: Frames) -> DataFrame:
    return lifecycle.stage_transition(f.life_now, f.life_before, count_days=True).select(
        "hashed_member_id", "stage", "days_in_stage")


@query
def stage_distribution(f: Frames) -> DataFrame:
    return lifecycle.stage_distribution(f.life_now)


@query
def stage_transitions(f: Frames) -> DataFrame:
    return lifecycle.stage_transitions(f.lifecycle)


@query
def winback_opportunity(f: Frames) -> DataFrame:
    return lifecycle.winback_opportunity(f.life_now)


@query
def reengaged_count(f: Frames) -> DataFrame:
    return lifecycle.reengaged_count(f.lifecycle)


@query
def engagement_score(f: Frames) -> DataFrame:
    return f.engagement


@query
def engagement_segment(f: Frames) -> DataFrame:
    return f.engagement.groupBy("membership_tier", "segment").agg(F.count(F.lit(1)).alias("members"))


@query
def segment_summary(f: Frames) -> DataFrame:
    return engagement.segment_summary(f.engagement)


@query
def engagement_quadrant(f: Frames) -> DataFrame:
    return engagement.engagement_quadrant(f.engagement)


@query
def tier_mismatch_check(f: Frames) -> DataFrame:
    return engagement.tier_mismatch_check(f.engagement)


# --- outcomes and revenue ------------------------------------------------------------------

@query
def intervention_outcomes(f: Frames) -> DataFrame:
    return f.intervention_outcomes()


@query
def band_join(f: Frames) -> DataFrame:
    """Visits after each intervention, counted per window."""
    return f.outcomes.select("audit_id", "sessions_post_7d", "sessions_post_14d", "sessions_post_30d")


@query
def conversion_rates(f: Frames) -> DataFrame:
    return outcomes.conversion_rates(f.outcomes)


@query
def channel_effectiveness(f: Frames) -> DataFrame:
    return outcomes.channel_effectiveness(f.outcomes)


@query
def outcome_distribution(f: Frames) -> DataFrame:
    return outcomes.outcome_distribution(f.outcomes)


@query
def treated_members(f: Frames) -> DataFrame:
    return f.treated


@query
def avg_lifetime_months(f: Frames) -> DataFrame:
    return f.lifetime


@query
def revenue_summary(f: Frames) -> DataFrame:
    return revenue.revenue_summary(f.outcomes, f.treated, f.lifetime)


@query
def channel_roi(f: Frames) -> DataFrame:
    return revenue.channel_roi(f.outcomes, f.treated)


@query
def studio_leaderboard(f: Frames) -> DataFrame:
    return revenue.studio_leaderboard(f.outcomes, f.treated, f.life_now)


@query
def km_retention(f: Frames) -> DataFrame:
    o = f.orders
    return revenue.km_retention(o["members"], o["ground_truth"], as_of=o["as_of"].scalar(), max_months=84)


@query
def running_survival(f: Frames) -> DataFrame:
    """The same curve over the activity members, three years long."""
    return revenue.km_retention(f.t["members"], f.t["ground_truth"], as_of=f.as_of)


@query
def rank_dense_index(f: Frames) -> DataFrame:
    board = f.raw("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return revenue.ranked(board, F.desc("orders"), F.asc("o_orderpriority"))


@query
def rank_first(f: Frames) -> DataFrame:
    """Position of every panel row by probability."""
    rows = f.scored_panel.select("row_key", "churn_probability")
    return ranking.global_row_number(rows, "churn_probability", "row_key")


@query
def hash_bernoulli(f: Frames) -> DataFrame:
    """A fixed 15 percent of the members, for instance for a survey."""
    return f.identity.select("member_id", X.hash_bernoulli(F.col("member_id"), F.lit(15), "survey").alias("drawn"))


@query
def winback_leaderboard(f: Frames) -> DataFrame:
    return f.board


@query
def bonus_pool(f: Frames) -> DataFrame:
    return winback.bonus_pool(f.board)


@query
def studio_rank(f: Frames) -> DataFrame:
    return winback.studio_rank(f.board)


@query
def observed_reactivations(f: Frames) -> DataFrame:
    return f.reactivations


@query
def studio_health(f: Frames) -> DataFrame:
    return reports.studio_health(f.scores, f.snapshot, f.outcomes)


# --- routing -----------------------------------------------------------------------------------

def _churn(f: Frames, live: bool = False) -> DataFrame:
    return routing.route_churn_actions(
        f.scores, f.identity, f.snapshot, f.audit, outcomes.channel_effectiveness(f.outcomes),
        now=NOW, holdout_salt=B.HOLDOUT_SALT, live=live)


@query
def holdout_assignment(f: Frames) -> DataFrame:
    return routing.holdout_assignment(f.identity, salt=B.HOLDOUT_SALT).select("member_id", "is_holdout")


@query
def cooldown_filter(f: Frames) -> DataFrame:
    return routing.cooldown_filter(f.identity, f.audit, now=NOW).select("member_id")


@query
def channel_escalation(f: Frames) -> DataFrame:
    """The audited channels as they would escalate at a high threshold."""
    rates = outcomes.channel_effectiveness(f.outcomes)
    after = routing.channel_escalation(F.col("action_type"), rates, threshold=0.99)
    return f.audit.select("action_type", after.alias("escalated_to")).groupBy(
        "action_type", "escalated_to").agg(F.count(F.lit(1)).alias("actions"))


@query
def route_churn_actions(f: Frames) -> DataFrame:
    return _churn(f).drop("counts_to_cap")


@query
def churn_audit_rows(f: Frames) -> DataFrame:
    return routing.audit_rows(_churn(f), run_id="r1", now=NOW).drop("message_body")


@query
def send_cap(f: Frames) -> DataFrame:
    """The live router stopped by the hourly cap."""
    return _churn(f, live=True).select(
        "hashed_member_id", "risk_score", "action_type", "status", "counts_to_cap")


@query
def running_send_count(f: Frames) -> DataFrame:
    """Number of each live send in the run's order, before any cap."""
    sends = routing.route_churn_actions(
        f.scores, f.identity, f.snapshot, f.audit, None, now=NOW, holdout_salt=B.HOLDOUT_SALT, live=True, cap=None
    ).filter("counts_to_cap").select("hashed_member_id", "risk_score")
    return ranking.global_row_number(sends, "risk_score", "hashed_member_id", descending=True, out="sent_so_far")


@query
def route_lifecycle_actions(f: Frames) -> DataFrame:
    return _life_actions(f)


@query
def route_segment_actions(f: Frames) -> DataFrame:
    return routing.route_segment_actions(
        f.engagement, f.identity, f.audit, now=NOW, holdout_salt=B.HOLDOUT_SALT).drop("counts_to_cap")


@query
def dispatch_stats(f: Frames) -> DataFrame:
    return routing.dispatch_stats(_churn(f))


@query
def sends_last_hour(f: Frames) -> DataFrame:
    return routing.sends_last_hour(f.audit, NOW)


@query
def ab_lift(f: Frames) -> DataFrame:
    return reports.ab_lift(f.audit, f.t["ground_truth"])


@query
def ab_significance(f: Frames) -> DataFrame:
    return reports.ab_significance(f.audit, f.t["ground_truth"]).select(
        "n_holdout", "n_treatment", "chi_square", F.round("p_value", 4).alias("p_value"), "significant")


@query
def ab_saved_revenue(f: Frames) -> DataFrame:
    return reports.ab_saved_revenue(f.audit, f.t["ground_truth"], f.t["memberships"])


@query
def ab_assignment_stability(f: Frames) -> DataFrame:
    """Order status as arms, where customers do cross over."""
    arms = f.raw("orders").select(
        F.col("o_custkey").cast("string").alias("member_id"),
        F.when(F.col("o_orderstatus") == "F", "Holdout").when(F.col("o_orderstatus") == "O", "Sent")
        .otherwise("RateLimited").alias("status"))
    return reports.ab_assignment_stability(arms)


@query
def top_k_per_group(f: Frames) -> DataFrame:
    return reports.studio_tasks(f.scores, f.snapshot, f.life_now, f.identity)


@query
def studio_digest(f: Frames) -> DataFrame:
    return reports.studio_digest(
        f.scores, f.snapshot, f.life_now, f.identity, f.outcomes, f.board)


# --- member briefs -----------------------------------------------------------------------------------

def _payload(f: Frames) -> DataFrame:
    return summaries.member_payload(
        f.snapshot, f.scores, f.lifecycle, f.identity, f.t["ai_coach_chats"], as_of=f.as_of)


@query
def member_payload(f: Frames) -> DataFrame:
    talk = F.array_join(F.transform("recent_chat_messages", lambda m: F.concat_ws(
        "~", m["timestamp"], m["sender"], m["text"])), " | ")
    return _payload(f).withColumn("recent_chat_messages", talk)


@query
def rules_summary(f: Frames) -> DataFrame:
    return summaries.rules_summary(_payload(f)).select(
        "hashed_member_id", "summary", "next_steps", "talking_points")


def _replies(f: Frames) -> DataFrame:
    """Payloads with replies of four kinds, chosen by tenure: good, prose around it, invented, broken."""
    body = F.concat(F.lit('{"summary": "Idle for '), F.col("days_since_last_session").cast("string"),
                    F.lit(' days", "next_steps": ["Call 2 times"], "talking_points": ["Hi"]}'))
    kind = F.col("tenure_days") % 4
    reply = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .when(kind == 2, F.replace(body, F.lit("Call 2"), F.lit("Call 7777777")))
        .otherwise("no json here")
    )
    return summaries.payload_json(_payload(f)).withColumn("reply", reply)


@query
def validate_summary_numbers(f: Frames) -> DataFrame:
    return summaries.validate_summary_numbers(_replies(f), text="reply").select(
        "hashed_member_id", "numbers_ok")


@query
def parse_summary_json(f: Frames) -> DataFrame:
    got = summaries.parse_summary_json(F.col("reply"))
    return _replies(f).select(
        "hashed_member_id", got["summary"].alias("summary"), got["next_steps"].alias("next_steps"))


@query
def finalize_summaries(f: Frames) -> DataFrame:
    return summaries.finalize_summaries(_replies(f)).select(
        "hashed_member_id", "summary", "source", "fallback_reason")


# --- quality, privacy, audit ------------------------------------------------------------------------------

@query
def dq_not_null(f: Frames) -> DataFrame:
    return quality.dq_not_null(f.panel, ["hashed_member_id", "date_day", "attendance_rate_30d"])


@query
def dq_unique(f: Frames) -> DataFrame:
    named = f.identity.join(f.raw("part").select("p_name", F.concat(
        F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("member_id")), "member_id", "left")
    return quality.dq_unique(named, ["member_id", "hashed_member_id", "p_name"])


@query
def dq_range(f: Frames) -> DataFrame:
    return quality.dq_range(f.panel, max_age=60)


@query
def label_distribution(f: Frames) -> DataFrame:
    return quality.label_distribution(f.panel)


@query
def dq_label_binary(f: Frames) -> DataFrame:
    return quality.dq_label_binary(f.panel)


@query
def dq_pii_values(f: Frames) -> DataFrame:
    """The panel with some contact names leaked into a text column."""
    leaky = f.panel.join(f.identity.select("hashed_member_id", "name"), "hashed_member_id").withColumn(
        "gender", F.when(F.col("gender") == "Other", F.col("name")).otherwise(F.col("gender"))).drop("name")
    return quality.dq_pii_values(leaky, f.identity)


@query
def dq_foreign_keys(f: Frames) -> DataFrame:
    return quality.dq_foreign_keys(f.t)


@query
def dq_row_counts(f: Frames) -> DataFrame:
    return quality.dq_row_counts(f.t, {"studios": 25})


@query
def dq_constant_flag(f: Frames) -> DataFrame:
    return quality.dq_row_counts(f.t).select("table_name", "flag_constant")


@query
def dq_signal_coverage(f: Frames) -> DataFrame:
    return quality.dq_signal_coverage(f.t["ground_truth"], f.t["transactions"])


@query
def dq_freshness(f: Frames) -> DataFrame:
    return quality.dq_freshness(
        {"sessions": (f.t["sessions"], "scheduled_at"), "transactions": (f.t["transactions"], "transaction_date"),
         "members": (f.t["members"], "join_date")},
        now=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query
def dq_volume_anomaly(f: Frames) -> DataFrame:
    return quality.dq_volume_anomaly(f.raw("events"), F.to_date("ts"), z_limit=1.5)


@query
def match_rate(f: Frames) -> DataFrame:
    pos, app = f.people
    resolved = identity.resolve_identities(pos, app, salt=B.SALT).select("member_id", "app_member_id")
    return identity.match_rate(resolved)


def _opted_out(f: Frames) -> DataFrame:
    """Customers with a negative balance, as if they had opted out."""
    gone = f.raw("customer").filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("M"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("member_id"))
    return f.identity.join(gone, "member_id", "left_semi")


@query
def apply_opt_out(f: Frames) -> DataFrame:
    return quality.apply_opt_out(f.t["members"], _opted_out(f)).select("member_id", "home_studio_id")


@query
def erase_members(f: Frames) -> DataFrame:
    left = quality.erase_members(
        {"identity": f.identity, "sessions": f.t["sessions"], "scores": f.scores, "audit": f.audit}, _opted_out(f))
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
            for n, df in left.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query
def record_hash(f: Frames) -> DataFrame:
    return f.auth_chain.select("seq", audit.record_hash(F.col("prev_hash")).alias("digest"))


def _auth_records(f: Frames) -> DataFrame:
    return f.auth.select(
        "line", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event", "outcome", "reason", "source",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "username")


def _read_back(f: Frames, lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A log written as text and read back, its records numbered along each chain."""
    path = runner.scratch_dir(f.spark, "auth-chains")
    lines.repartition(*by).sortWithinPartitions(*by, *order).select("line").write.text(path)
    log = audit.parse_auth_lines(audit.number_lines(f.spark, path)).withColumn("day", F.left("ts", F.lit(10)))
    return ranking.group_row_number(log.drop("seq"), by, "line", out="seq")


@query
def prev_row_link(f: Frames) -> DataFrame:
    """The links of one chain per day, in segments of 64 records; every tenth record's outcome is edited."""
    chains = audit.linked_log(_auth_records(f), ["day"], "line", segment=64)
    edited = F.regexp_replace("line", '"outcome":"[a-z]+"', '"outcome":"forged"')
    lines = chains.withColumn("line", F.when(F.col("seq") % 10 == 0, edited).otherwise(F.col("line")))
    log = _read_back(f, lines, ["day"], ["seq"])
    return audit.check_hash_chain(log, by=("day",), segment=64).select("day", "seq", "linked", "intact")


@query
def verify_hash_chain(f: Frames) -> DataFrame:
    """A log of one chain per user and day, with some lines edited or lost, written and read back.

    Of users with numbers divisible by three, the second record gets a key more; with remainder one it is lost
    if a third follows, and with remainder two the last of three or more, which only the seals tell.
    """
    by, rest = ["username", "day"], F.substring("username", 5, 20).cast("long") % 3
    chains = checkpointed(audit.linked_log(_auth_records(f), by, "line", segment=4))
    written = chains.select(*by, "seq", F.get_json_object("line", "$.hash").alias("hash"))
    seals = audit.chain_seals(written, by, segment=4)
    lines = chains.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    second, last = F.col("seq") == 2, F.col("seq") == F.col("n")
    edited = F.when(second & (rest == 0), F.regexp_replace("line", r"\}$", ', "note": "forged"}')).otherwise(F.col("line"))
    lost = (F.col("n") > 2) & (second & (rest == 1) | last & (rest == 2))
    log = _read_back(f, lines.filter(~lost).withColumn("line", edited), by, ["seq"])
    return audit.verify_hash_chain(log, by=("username", "day"), segment=4, seals=seals)


@query
def failures_since_success(f: Frames) -> DataFrame:
    return audit.failures_since_success(f.auth)


@query
def lockout_status(f: Frames) -> DataFrame:
    return audit.lockout_status(
        f.auth, now=f.now, max_failures=2, window_min=240, lockout_min=240)


@query
def auth_failure_summary(f: Frames) -> DataFrame:
    return audit.auth_failure_summary(f.auth, now=f.now, minutes=600)


@query
def oversight_log(f: Frames) -> DataFrame:
    views = f.raw("events").select(
        F.col("event_id").alias("access_id"), F.col("ts").alias("accessed_at"),
        F.col("event_type").alias("admin_user"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("viewed_studio"))
    return audit.oversight_log(views)


# --- identity -------------------------------------------------------------------------------------------------

@query
def normalize_contacts(f: Frames) -> DataFrame:
    return identity.normalize_contacts(f.people[1]).select(
        "app_member_id", "norm_email", "norm_phone", "norm_name")


@query
def jaro_winkler(f: Frames) -> DataFrame:
    """Each app name against the name of the same customer on the other side."""
    pos, app = f.people
    pairs = app.join(pos.select("row_order", F.col("name").alias("pos_name")), "row_order")
    other = F.concat("pos_name", F.lit(" "), F.right(F.col("app_member_id"), F.lit(2)))
    return pairs.select("app_member_id", F.round(identity.jaro_winkler(F.col("name"), other), 6).alias("similarity"))


@query
def match_exact_contacts(f: Frames) -> DataFrame:
    return identity.match_exact_contacts(*f.people)


@query
def shared_email_guard(f: Frames) -> DataFrame:
    """Point-of-sale rows with one email per nation, so that every email is shared."""
    pos, app = f.people
    shared = pos.withColumn("email", F.concat(F.substring_index("name", " ", -1), F.lit("@example.test")))
    return identity.match_exact_contacts(shared, app, shared_email_guard=True)


@query
def fuzzy_candidates(f: Frames) -> DataFrame:
    pos, app = (identity.normalize_contacts(x) for x in f.people)
    exact = checkpointed(identity.match_exact_contacts(*f.people))
    return identity.fuzzy_candidates(
        pos.join(shuffled(exact), "member_id", "left_anti"), app.join(shuffled(exact), "app_member_id", "left_anti")
    ).select("member_id", "app_member_id")


@query
def resolve_identities(f: Frames) -> DataFrame:
    return identity.resolve_identities(*f.people, salt=B.SALT)


# --- model ---------------------------------------------------------------------------------------------------------

@query
def training_window(f: Frames) -> DataFrame:
    return model.training_window_meta(f.panel, as_of=f.as_of, months=2)


@query
def quantile_date(f: Frames) -> DataFrame:
    return model.quantile_date(model.training_window(f.panel, as_of=f.as_of))


@query
def chronological_split(f: Frames) -> DataFrame:
    window = model.training_window(f.panel, as_of=f.as_of)
    train, held = model.chronological_split(window)
    sides = [df.agg(F.count(F.lit(1)).alias("rows"), F.min("date_day").alias("first_day"),
                    F.max("date_day").alias("last_day")).select(F.lit(n).alias("side"), "rows", "first_day", "last_day")
             for n, df in (("train", train), ("validation", held))]
    return sides[0].unionByName(sides[1])


@query
def class_weight(f: Frames) -> DataFrame:
    return model.class_weight(f.panel)


@query
def auc_roc(f: Frames) -> DataFrame:
    return evaluation.auc_roc(f.scored_panel)


@query
def average_precision(f: Frames) -> DataFrame:
    return evaluation.average_precision(f.scored_panel)


@query
def roc_curve(f: Frames) -> DataFrame:
    return evaluation.roc_curve(f.scored_panel)


@query
def confusion_at(f: Frames) -> DataFrame:
    return evaluation.confusion_at(f.scored_panel)


@query
def classification_report(f: Frames) -> DataFrame:
    return evaluation.classification_report(f.scored_panel)


@query
def precision_at_top_k(f: Frames) -> DataFrame:
    return evaluation.precision_at_top_k(f.scored_panel)


@query
def calibration_curve_uniform(f: Frames) -> DataFrame:
    return evaluation.calibration_curve_uniform(f.scored_panel)


@query
def fairness_slices(f: Frames) -> DataFrame:
    return evaluation.fairness_slices(f.scored_panel)


@query
def calibration_deciles(f: Frames) -> DataFrame:
    return monitoring.calibration_deciles(monitoring.mature_window(f.scored_panel, f.as_of))


@query
def drift_windows(f: Frames) -> DataFrame:
    """Sizes of the windows without a registered training window."""
    ref, cur = monitoring.drift_windows(f.panel, f.as_of, recent_days=20)
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min("date_day").alias("first_day"), F.max("date_day").alias("last_day"))
             .select(F.lit(n).alias("side"), "rows", "first_day", "last_day") for n, df in (("reference", ref), ("current", cur))]
    return parts[0].unionByName(parts[1])


@query
def perturb_window(f: Frames) -> DataFrame:
    _, cur = monitoring.drift_windows(f.panel, f.as_of)
    return monitoring.perturb_window(cur).groupBy("date_day").agg(
        F.sum("sessions_attended_30d").alias("attended"), F.sum("days_since_last_session").alias("idle"),
        F.sum("app_logins_30d").alias("logins"), F.sum("failed_payments_count_30d").alias("failed"))


def _drift(f: Frames, perturb: bool) -> DataFrame:
    windows = monitoring.drift_flags(f.as_of, train_start="2024-01-01", train_end="2024-01-15", recent_days=10)
    return monitoring.window_drift(f.panel, *windows, perturb=perturb)


@query
def feature_drift(f: Frames) -> DataFrame:
    return _drift(f, False)


@query
def feature_drift_perturbed(f: Frames) -> DataFrame:
    return _drift(f, True)


@query
def psi(f: Frames) -> DataFrame:
    """Item value drift between the two halves of the line items' ship years."""
    lines = f.raw("lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return monitoring.psi_of_windows(lines, early, ~early, ["l_quantity", "l_extendedprice", "l_discount"])


@query
def retrain_decision(f: Frames) -> DataFrame:
    calibration = monitoring.calibration_deciles(monitoring.mature_window(f.scored_panel, f.as_of))
    return monitoring.retrain_decision(calibration, _drift(f, True), checked_at=f.now, mode="simulate-drift")


@query
def feature_vectors(f: Frames) -> DataFrame:
    """The snapshot's vectors: scaled numbers, the place of each category's one, and the flags."""
    from pyspark.ml.functions import vector_to_array

    v = model.feature_vectors(f.snapshot).select("*", vector_to_array("features").alias("v"))
    at = len(C.NUMERIC_FEATURES)
    sizes = f.snapshot.agg(*[F.count_distinct(c).alias(c) for c in C.CATEGORICAL_FEATURES]).first()
    hot = []
    for c in C.CATEGORICAL_FEATURES:
        hot.append((F.array_position(F.slice("v", at + 1, sizes[c] + 1), 1.0) - 1).alias(f"{c}_at"))
        at += sizes[c] + 1  # and one place for values not seen in training
    flags = [F.col("v")[at + i].cast("int").alias(b) for i, b in enumerate(C.BOOLEAN_FEATURES)]
    numbers = [F.col("v")[i].alias(n) for i, n in enumerate(C.NUMERIC_FEATURES)]
    return v.select("hashed_member_id", *numbers, *hot, *flags, F.size("v").alias("width"))


@query
def train_churn_lr(f: Frames) -> DataFrame:
    """Ranking quality of the linear model on the validation rows."""
    train, held = f.split
    scored = model.train_churn_lr(train).predict(held).withColumn("actual", F.col(C.LABEL))
    return evaluation.auc_roc(scored)


@query
def train_churn_gbt(f: Frames) -> DataFrame:
    """The largest importances of the boosted trees."""
    return model.feature_importance(f.trained, f.snapshot)


@query
def score_members(f: Frames) -> DataFrame:
    """The saved and calibrated trees, loaded and applied to the latest snapshot."""
    return model.score_members(f.trained, f.snapshot)


@query
def score_members_check(f: Frames) -> DataFrame:
    """What must hold of the scores: one per member, in bounds, with the tier of the stored probability."""
    p, tier = F.col("churn_probability"), F.col("risk_tier")
    return model.score_members(f.trained, f.snapshot).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("hashed_member_id").alias("members"),
        F.bool_and(p.between(0.0, 1.0)).alias("in_bounds"),
        F.bool_and(tier == X.risk_tier(p)).alias("tiers_match"))


def _registry(f: Frames) -> DataFrame:
    """The training run's record, and that of an earlier one with a shorter window."""
    train, held = f.split
    scored = f.trained.predict(held).withColumn("actual", F.col(C.LABEL))
    metrics = train.agg(F.count(F.lit(1)).alias("train_rows")).withColumns({
        "val_rows": held.agg(F.count(F.lit(1))).scalar(),
        "scale_pos_weight": model.class_weight(train).select("scale_pos_weight").scalar(),
        "val_auc": evaluation.auc_roc(scored).select("auc_roc").scalar(),
        "val_pr_auc": evaluation.average_precision(scored).select("average_precision").scalar()})

    def record(version: str, months: int, day: str) -> DataFrame:
        return model.registry_record(
            model.training_window_meta(f.panel, as_of=f.as_of, months=months), metrics, version_id=version,
            trained_at=F.lit(day).cast("timestamp_ntz"), trigger="manual", window_months=months, model_path=f.model_path)

    return record("v1", 1, "2024-01-29 00:00:00").unionByName(record("v2", 24, "2024-01-30 00:00:00"))


def _checked_record(rows: DataFrame) -> DataFrame:
    """Metrics as checks and the path without its folder, so that a record can be compared with SQL."""
    return rows.withColumns({
        "val_auc": F.col("val_auc").between(0.0, 1.0), "val_pr_auc": F.col("val_pr_auc").between(0.0, 1.0),
        "model_path": F.regexp_extract("model_path", "(churn-model)-[0-9a-f]+$", 1)})


@query
def model_registry(f: Frames) -> DataFrame:
    return _checked_record(_registry(f))


@query
def registry_latest(f: Frames) -> DataFrame:
    return _checked_record(model.registry_latest(_registry(f)))


@query
def calibrate_isotonic(f: Frames) -> DataFrame:
    """The map fitted to the panel's stand-in probabilities: it never falls, stays in bounds, and keeps the mean."""
    rows = f.scored_panel.select(F.col("churn_probability").alias("raw_probability"), F.col("actual").cast("double").alias("label"))
    fitted = model.fit_isotonic(rows)
    points = fitted.transform(rows.groupBy(F.round("raw_probability", 4).alias("raw_probability")).agg(
        F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n")))
    steps = points.groupBy("raw_probability").agg(F.min("churn_probability").alias("low")).orderBy("raw_probability")
    falls = steps.agg(F.array_sort(F.collect_list(F.struct("raw_probability", "low"))).alias("s")).select(
        (F.col("s.low") == F.array_sort("s.low")).alias("rises"))
    p = F.col("churn_probability")
    return points.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("points"),
        F.round(F.sum(p * F.col("n")) / F.sum("n"), 6).alias("mean_calibrated"),
        F.bool_and(p.between(0.0, 1.0)).alias("in_bounds")).withColumn("rises", falls.scalar())


# --- exploration ------------------------------------------------------------------------------------------------------

@query
def monthly_signups(f: Frames) -> DataFrame:
    return explore.monthly_signups(f.orders["members"])


@query
def booking_heatmap(f: Frames) -> DataFrame:
    return explore.booking_heatmap(f.t["sessions"])


@query
def active_at_month(f: Frames) -> DataFrame:
    o = f.orders
    return explore.active_at_month(o["members"], o["ground_truth"],
        first=o["members"].agg(F.min("join_date")).scalar(), last=f.raw("orders").agg(F.max("o_orderdate")).scalar())


@query
def fail_to_cancel_lag(f: Frames) -> DataFrame:
    return explore.fail_to_cancel_lag(f.t["ground_truth"], f.t["transactions"])


@query
def attendance_by_lifetime_decile(f: Frames) -> DataFrame:
    return explore.attendance_by_lifetime_decile(f.t["members"], f.t["ground_truth"], f.t["sessions"])


# --- streams ---------------------------------------------------------------------------------------------------------------

# The day the first delivery ends with, and the last day of which rows come late.
_DELIVERED, _LATE = "2024-01-20", "2024-01-10"
_FAR = "2024-06-30 00:00:00"


def _activity_run(f: Frames, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The activity in three deliveries: early days, later days with rows that come late, and one far later event.

    Late are the first days of members with numbers divisible by five. The last event closes all windows.
    """
    events = checkpointed(streams.activity_events(
        f.t["sessions"], f.t["app_events"], f.t["email_events"], f.t["transactions"], f.t["ai_coach_chats"]))
    day = F.to_date("ts")
    late = (day <= F.lit(_LATE).cast("date")) & (F.substring("member_id", 2, 20).cast("long") % 5 == 0)
    early = (day <= F.lit(_DELIVERED).cast("date")) & ~late
    closing = events.limit(1).select(F.lit("closing").alias("member_id"), F.lit(_FAR).cast("timestamp_ntz").alias("ts"), F.lit("chat").alias("kind"))
    out = runner.run_deliveries([events.filter(early), events.filter(~early), closing], build, name)
    return out.filter(F.col("member_id") != "closing")


@query
def stream_daily_activity(f: Frames) -> DataFrame:
    """Late rows are passed over: their days were final before they came."""
    return _activity_run(f, streams.stream_daily_activity, "daily")


@query
def stream_late_rows(f: Frames) -> DataFrame:
    """The rows that ``stream_daily_activity`` has passed over."""
    return _activity_run(f, streams.stream_late_rows, "late")


@query
def stream_rolling_activity(f: Frames) -> DataFrame:
    return _activity_run(f, streams.stream_rolling_activity, "rolling")


@query
def rolling_activity(f: Frames) -> DataFrame:
    """The same windows over the whole history as a batch, with no row late."""
    return streams.rolling_activity(streams.activity_events(
        f.t["sessions"], f.t["app_events"], f.t["email_events"], f.t["transactions"], f.t["ai_coach_chats"]))


@query
def stream_send_rate_guard(f: Frames) -> DataFrame:
    """The audit in two deliveries and a closing event of another status."""
    sends = checkpointed(f.audit.select("sent_at", "status"))
    early = F.to_date("sent_at") <= F.lit(_DELIVERED).cast("date")
    closing = sends.limit(1).select(F.lit(_FAR).cast("timestamp_ntz").alias("sent_at"), F.lit("Sent").alias("status"))
    return runner.run_deliveries(
        [sends.filter(early), sends.filter(~early), closing], lambda s: streams.stream_send_rate_guard(s, limit=2), "guard")


@query
def stream_intent_flags(f: Frames) -> DataFrame:
    """Payments and chats in two deliveries, of which the second brings some of the first's events again."""
    columns = {"transactions": "transaction_id as event_id, member_id, cast(transaction_date as timestamp_ntz) as ts, status, cast(null as string) as sender, cast(null as string) as message_text",
               "ai_coach_chats": "chat_id as event_id, member_id, timestamp as ts, cast(null as string) as status, sender, message_text"}
    both = checkpointed(f.t["transactions"].selectExpr(*columns["transactions"].split(", ")).unionByName(
        f.t["ai_coach_chats"].selectExpr(*columns["ai_coach_chats"].split(", "))))
    early = F.to_date("ts") <= F.lit(_DELIVERED).cast("date")
    again = F.to_date("ts") == F.lit(_DELIVERED).cast("date")

    def flags(events: DataFrame) -> DataFrame:
        payments = events.filter(F.col("status").isNotNull()).select(
            F.col("event_id").alias("transaction_id"), "member_id", F.col("ts").alias("transaction_date"), "status")
        chats = events.filter(F.col("sender").isNotNull()).select(
            F.col("event_id").alias("chat_id"), "member_id", F.col("ts").alias("timestamp"), "sender", "message_text")
        return streams.stream_intent_flags(payments, chats, delay="1 day")

    return runner.run_deliveries([both.filter(early), both.filter(~early | again)], flags, "flags")


@query
def stream_member_sessions(f: Frames) -> DataFrame:
    return _activity_run(f, lambda s: streams.stream_member_sessions(s, delay="1 day"), "bursts")


@query
def stream_lockout(f: Frames) -> DataFrame:
    """A real stream over the event files with state per user name and source."""
    events = B.auth_events(runner.read_stream(f.spark, f.sf_dir, "events"))
    return runner.run_available(
        lockout.stream_lockout(events, max_failures=2, window_min=600, lockout_min=60), "lockout")
