"""Boundary rows and fixed examples for the rules."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import (
    activity, engagement, features, lifecycle, outcomes, quality, reports, revenue, routing, scoring,
    summaries, winback,
)

D = dt.date


def one(df):
    return df.first().asDict()


def test_risk_tier_boundaries(spark):
    df = spark.createDataFrame([(p,) for p in (0.1999, 0.20, 0.4999, 0.50, 0.8499, 0.85, 1.0, None)], "p double")
    got = [r[0] for r in df.select(X.risk_tier(F.col("p"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "Critical", "Critical", None]


def test_stage_boundaries(spark):
    rows = [
        (True, None, 0, 0, 999, "Low", "cancelled"), (True, -3, 0, 0, 999, "Low", "cancelled"),
        (True, 6, 0, 0, 999, "Low", "cancelled"), (True, 7, 0, 0, 999, "Low", "win_back_eligible"),
        (True, 90, 0, 0, 999, "Low", "win_back_eligible"), (True, 91, 0, 0, 999, "Low", "win_back_expired"),
        (False, None, 30, 0, 999, "Critical", "onboarding"), (False, None, 31, 0, 31, "Critical", "lapsed"),
        (False, None, 31, 0, 30, "Medium", "at_risk"), (False, None, 31, 1, 31, "Low", "engaged"),
        (False, None, 31, 5, 1, "High", "at_risk"),
    ]
    df = spark.createDataFrame(rows, (
        "gone boolean, days int, tenure_days int, sessions_attended_30d int, days_since_last_session int, "
        "risk_tier string, want string"))
    got = df.select(lifecycle.stage_of(F.col("gone"), F.col("days")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_segment_boundaries(spark):
    rows = [
        ("Basic", 70.0, "upsell_candidate"), ("Basic", 69.9, "engaged"), ("Premium", 39.9, "under_engaged_payer"),
        ("Premium", 40.0, "engaged"), ("VIP", 24.9, "at_risk_silent"), ("VIP", 25.0, "engaged"),
        ("VIP", 75.0, "champion"), ("VIP", 74.9, "engaged"), ("Premium", 20.0, "under_engaged_payer"),
    ]
    df = spark.createDataFrame(rows, "membership_tier string, engagement_score double, want string")
    got = df.select(engagement.engagement_segment().alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_same_day_paid_wins_over_failed(spark):
    rows = [("a", D(2024, 1, 1), 10.0, "Membership Fee", "Failed"), ("a", D(2024, 1, 1), 10.0, "Membership Fee", "Paid"),
            ("a", D(2024, 1, 1), 5.0, "Retail - X", "Paid"), ("a", D(2024, 1, 1), 7.0, "Retail - X", "Failed")]
    tx = spark.createDataFrame(rows, "member_id string, transaction_date date, amount double, transaction_type string, status string")
    got = one(activity.daily_transactions(tx))
    assert (got["membership_status"], got["membership_failed_count"], got["retail_spend"]) == ("Paid", 1, 5.0)


def _tables(spark):
    """Two members with activity before joining, after churn and on both sides of the windows."""
    members = spark.createDataFrame(
        [("a", "A", "a@x", "1", "F", D(1990, 1, 1), "S1", D(2024, 1, 1)), ("b", "B", "b@x", "2", "M", D(1980, 1, 1), None, D(2024, 1, 10))],
        "member_id string, name string, email string, phone string, gender string, dob date, home_studio_id string, join_date date")
    truth = spark.createDataFrame([("a", True, D(2024, 2, 20)), ("b", False, None)], "member_id string, churned boolean, churn_date date")
    plans = spark.createDataFrame([("p", "a", "S1", "Basic", 59.0), ("q", "b", "S1", "VIP", 99.0)],
                                  "membership_id string, member_id string, studio_id string, membership_tier string, monthly_price double")
    t = lambda d: dt.datetime(2024, *d, 10)
    sessions = spark.createDataFrame(
        [("a", t((1, 1)), True, 125.0), ("a", t((1, 5)), False, 120.0), ("a", t((1, 31)), True, 121.0), ("a", t((2, 25)), True, 130.0),
         ("b", t((1, 2)), True, 120.0), ("b", t((2, 28)), True, 122.0)],
        "member_id string, scheduled_at timestamp_ntz, attended boolean, sauna_temp_f double")
    tx = spark.createDataFrame([("a", D(2024, 1, 3), 50.0, "Membership Fee", "Failed"), ("a", D(2024, 2, 3), 50.0, "Membership Fee", "Paid"),
                                ("a", D(2024, 2, 4), 9.5, "Retail - T", "Paid")],
                               "member_id string, transaction_date date, amount double, transaction_type string, status string")
    app = spark.createDataFrame([("a", "open_app", t((1, 2)))], "member_id string, event_type string, event_timestamp timestamp_ntz")
    chats = spark.createDataFrame([("a", t((1, 2)), "member", "please FREEZE it"), ("a", t((1, 3)), "coach", "cancel?")],
                                  "member_id string, timestamp timestamp_ntz, sender string, message_text string")
    emails = spark.createDataFrame([("a", t((1, 2)), "Clicked")], "member_id string, sent_at timestamp_ntz, status string")
    return {"members": members, "ground_truth": truth, "memberships": plans, "sessions": sessions, "transactions": tx,
            "app_events": app, "ai_coach_chats": chats, "email_events": emails}


def test_panel_window_edges(spark):
    t = _tables(spark)
    rows = {(r["gender"], r["date_day"]): r for r in features.member_features_daily(t, salt="s").collect()}
    a, b = (lambda *d: rows[("F", D(2024, *d))]), (lambda *d: rows[("M", D(2024, *d))])
    assert max(d for g, d in rows if g == "F") == D(2024, 2, 20)
    assert max(d for g, d in rows if g == "M") == D(2024, 2, 28)
    assert min(d for g, d in rows if g == "M") == D(2024, 1, 10)
    assert (a(1, 30)["sessions_attended_30d"], a(1, 31)["sessions_attended_30d"], a(2, 1)["sessions_attended_30d"]) == (1, 1, 1)
    assert (a(1, 7)["sessions_booked_7d"], a(1, 8)["sessions_booked_7d"]) == (2, 1)
    assert a(2, 20)["days_since_last_session"] == 20
    assert b(1, 10)["days_since_last_session"] == 999 and b(1, 10)["attendance_rate_30d"] is None
    assert a(2, 2)["last_recurring_payment_failed"] and not a(2, 3)["last_recurring_payment_failed"]
    assert (a(2, 4)["retail_spend_30d"], a(2, 3)["retail_spend_30d"]) == (9.5, 0.0)
    assert a(1, 2)["has_cancellation_query_30d"] and not a(2, 1)["has_cancellation_query_30d"]
    assert [a(2, d)["is_churned_14d"] for d in (5, 6, 19, 20)] == [False, True, True, False]


@pytest.mark.parametrize("day", ["2024-01-10", "2024-02-10", "2024-02-28"])
def test_snapshot_and_incremental_equal_the_panel(spark, day):
    t = _tables(spark)
    key = lambda rows: sorted(tuple(r) for r in rows)
    panel = features.member_features_daily(t, salt="s")
    want = key(panel.filter(F.col("date_day") == F.lit(day).cast("date")).collect())
    assert key(features.member_features_snapshot(t, salt="s", as_of=day).collect()) == want
    since = features.member_features_daily(t, salt="s", since=day)
    assert key(since.filter(F.col("date_day") == F.lit(day).cast("date")).collect()) == want


def test_outcome_windows(spark):
    sent = dt.datetime(2024, 1, 1, 9)
    audit = spark.createDataFrame(
        [(m, m, m, sent, "Email", "Sent", why) for m, why in
         [("v7", "Score: 1 | Tier: High"), ("v8", "none"), ("pay", None), ("gone", "Tier: Low"), ("lost", "x"), ("quiet", "x"), ("late", "x")]],
        "audit_id string, member_id string, hashed_member_id string, sent_at timestamp_ntz, action_type string, status string, why_score string")
    visits = [("v7", D(2024, 1, 8)), ("v7", D(2024, 1, 8)), ("v7", D(2024, 1, 1)), ("v8", D(2024, 1, 9))]
    sessions = spark.createDataFrame([(m, dt.datetime.combine(d, dt.time(8)), True) for m, d in visits],
                                     "member_id string, scheduled_at timestamp_ntz, attended boolean")
    tx = spark.createDataFrame([("pay", D(2024, 1, 15), "Membership Fee", "Paid"), ("pay", D(2024, 1, 1), "Membership Fee", "Paid")],
                               "member_id string, transaction_date date, transaction_type string, status string")
    truth = spark.createDataFrame(
        [("v7", False, None), ("v8", False, None), ("pay", True, D(2024, 3, 1)), ("gone", True, D(2023, 12, 1)),
         ("lost", True, D(2024, 1, 31)), ("late", True, D(2024, 2, 1))], "member_id string, churned boolean, churn_date date")
    got = {r.member_id: r for r in outcomes.intervention_outcomes(audit, sessions, tx, truth).collect()}
    assert (got["v7"].outcome_7d, got["v7"].sessions_post_7d, got["v7"].risk_tier) == ("re_engaged", 1, "High")
    assert (got["v8"].outcome_7d, got["v8"].outcome_14d, got["v8"].risk_tier) == ("still_active", "re_engaged", "Unknown")
    assert (got["pay"].outcome_7d, got["pay"].outcome_14d, got["pay"].payment_resolved_within_30d) == ("no_response", "payment_resolved", True)
    assert (got["gone"].outcome_7d, got["gone"].churned_within_30d) == ("churned", False)
    assert (got["lost"].outcome_30d, got["lost"].churned_within_30d) == ("churned", True)
    assert (got["late"].outcome_30d, got["late"].churned_within_30d) == ("no_response", False)
    assert got["quiet"].outcome_30d == "still_active"


def _actions(spark, n, calls=()):
    rows = [(f"{i:04d}", 1.0 - i / 1000, i not in calls) for i in range(n)]
    return spark.createDataFrame(rows, "hashed_member_id string, risk_score double, counts_to_cap boolean")


@pytest.mark.parametrize("prior, calls, kept, halted", [
    (0, (), 50, "0050"), (10, (), 40, "0040"), (50, (), 0, "0000"), (70, (2,), 0, "0000"), (0, (0, 60), 51, "0051")])
def test_send_cap_stops_at_the_breach(spark, prior, calls, kept, halted):
    out = routing.send_cap(_actions(spark, 70, calls), prior=F.lit(prior)).collect()
    assert sum(not r.halted for r in out) == kept
    assert [r.hashed_member_id for r in out if r.halted] == [halted]


def test_send_cap_without_breach_keeps_all(spark):
    out = routing.send_cap(_actions(spark, 50), prior=F.lit(0))
    assert out.filter("halted").count() == 0 and out.count() == 50


def test_hash_rules_equal_hashlib(spark):
    ids = [f"M{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "member_id string")
    got = df.select(
        "member_id", X.in_holdout(F.col("member_id"), "pepper").alias("h"),
        X.hash_bernoulli(F.col("member_id"), F.lit(15), "winback").alias("b")).collect()
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        assert r.h == (int(hexed(r.member_id + "pepper")[-4:], 16) % 10 == 0)
        assert r.b == (int(hexed(r.member_id + "winback")[:8], 16) % 100 < 15)


def test_escalation_and_unknown_rates(spark):
    rates = spark.createDataFrame([("Email", 0.09), ("SMS", 0.5)], "action_type string, positive_rate double")
    df = spark.createDataFrame([("Email",), ("SMS",), ("Call",)], "c string")
    assert [r[0] for r in df.select(routing.channel_escalation(F.col("c"), rates)).collect()] == ["SMS", "SMS", "Call"]
    only = rates.filter("action_type = 'Call'")
    assert [r[0] for r in df.select(routing.channel_escalation(F.col("c"), only)).collect()] == ["Email", "SMS", "Call"]


def test_mode_ties_and_null_studio(spark):
    o = spark.createDataFrame(
        [("1", "h", "SMS", False, "churned"), ("2", "h", "Email", False, "re_engaged"), ("3", "g", "Call", True, "churned")],
        "audit_id string, hashed_member_id string, action_type string, churned_within_30d boolean, outcome_30d string")
    life = spark.createDataFrame(
        [("h", 100.0, None, 0.5, "at_risk", D(2024, 1, 1)), ("g", 50.0, "S1", 1.0, "cancelled", D(2024, 1, 1))],
        "hashed_member_id string, monthly_price double, home_studio_id string, churn_probability double, stage string, snapshot_date date")
    treated = revenue.treated_members(o, life)
    got = {r.hashed_member_id: r for r in treated.collect()}
    assert got["h"].primary_channel == "Email" and got["h"].confirmed_save and got["h"].saved_mrr == 12.5
    assert got["g"].effectiveness == 0.08 and got["g"].lost_mrr == 50.0
    board = revenue.studio_leaderboard(o, treated, life).collect()
    assert [(r["home_studio_id"], r["rank"], r["spend"]) for r in board] == [("S1", 1, 5.0)]


def test_retention_never_rises_and_bonus_adds_up(spark, sf_dir):
    from tidemark.plans.context import Frames

    f = Frames(spark, sf_dir)
    o = f.orders
    km = [r.retention for r in revenue.km_retention(o["members"], o["ground_truth"], as_of=o["as_of"].scalar(), max_months=80).collect()]
    assert all(b <= a for a, b in zip(km, km[1:])) and km[-1] < 1
    rows = f.board.collect()
    pool = one(winback.bonus_pool(f.board))["bonus_pool"]
    assert abs(sum(r.bonus_award for r in rows) - pool) < 0.01 * len(rows) + 1e-9


def test_stage_transition_counts_runs_and_days(spark):
    now = spark.createDataFrame([("a", "engaged", D(2024, 1, 8)), ("b", "lapsed", D(2024, 1, 8)), ("c", "engaged", D(2024, 1, 8))],
                                "hashed_member_id string, stage string, snapshot_date date")
    prior = spark.createDataFrame([("a", "engaged", D(2024, 1, 1), 3), ("b", "at_risk", D(2024, 1, 1), 3)],
                                  "hashed_member_id string, stage string, stage_entered_at date, days_in_stage int")
    got = {r.hashed_member_id: r for r in lifecycle.stage_transition(now, prior).collect()}
    assert (got["a"].days_in_stage, got["a"].stage_entered_at) == (4, D(2024, 1, 1))
    assert (got["b"].days_in_stage, got["b"].previous_stage, got["b"].stage_entered_at) == (0, "at_risk", D(2024, 1, 8))
    assert got["c"].previous_stage is None
    days = {r.hashed_member_id: r.days_in_stage for r in lifecycle.stage_transition(now, prior, count_days=True).collect()}
    assert days == {"a": 7, "b": 0, "c": 0}


def test_ab_readouts_on_an_empty_arm(spark):
    queue = spark.createDataFrame([("a", "Sent"), ("b", "DryRun"), ("a", "Sent")], "member_id string, status string")
    truth = spark.createDataFrame([("a", True), ("b", False)], "member_id string, churned boolean")
    got = one(reports.ab_lift(queue, truth))
    assert (got["n_treatment"], got["n_holdout"], got["rate_treatment"], got["lift"]) == (2, 0, 0.5, None)


PAYLOADS = [
    ("Premium", "Critical", True, True, 16), ("VIP", "Low", False, False, 1), ("Basic", "High", False, False, 41)]


def test_rules_summary_profiles(spark):
    df = spark.createDataFrame(PAYLOADS, (
        "membership_tier string, churn_risk_tier string, recent_payment_failed boolean, "
        "has_cancellation_query_30d boolean, days_since_last_session int"))
    high, low, lapsed = summaries.rules_summary(df).collect()
    assert "payment" in high.summary and "cancel" in high.summary and "16" in high.summary
    assert "payment" not in low.summary and len(low.next_steps) == 1 and "Check in" in low.next_steps[0]
    assert "41" in lapsed.summary and lapsed.next_steps and lapsed.talking_points


def test_number_validator(spark):
    rows = [("Costs $150 for 60 days", False), ("Pays $129, idle 16 days", True), ("Risk is 97.3%", True), ("Try 2 sessions", True)]
    df = spark.createDataFrame(rows, "text string, want boolean").withColumns({
        "payload": F.lit('{"monthly_price": 129.0, "churn_probability": 0.973, "idle": 16}'),
        "churn_probability": F.lit(0.973), "attendance_rate_30d": F.lit(None).cast("double"),
        "email_open_rate_30d": F.lit(0.0)})
    got = summaries.validate_summary_numbers(df).collect()
    assert [r.numbers_ok for r in got] == [r.want for r in got]


def test_tolerant_json(spark):
    rows = ['{"summary": "s", "next_steps": ["a"]}', '```json\n{"summary": "s", "next_steps": ["a"]}\n```', "not json", '{"summary": "s"}', None]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = [r[0] for r in df.select(summaries.parse_summary_json(F.col("raw"))).collect()]
    assert [g.summary if g else None for g in got] == ["s", "s", None, None, None]


def test_payload_is_free_of_contacts():
    assert not {"name", "email", "phone"} & set(summaries.PAYLOAD_FIELDS) and len(summaries.PAYLOAD_FIELDS) == 21


def test_scope_rejects_odd_identifiers(spark):
    with pytest.raises(ValueError):
        scoring.scope_to_studio({}, "S1' OR '1'='1")


def test_pii_columns_are_reported(spark):
    df = spark.createDataFrame([], "hashed_member_id string, Email string, member_id string")
    assert sorted(r[0] for r in quality.dq_pii_columns(df).collect()) == ["Email", "member_id"]


def test_quality_rules_hold_on_own_panel(spark, sf_dir):
    from tidemark.plans.context import Frames

    f = Frames(spark, sf_dir)
    assert set(one(quality.dq_range(f.panel)).values()) == {0}
    assert one(quality.dq_pii_values(f.panel, f.identity))["leaked_values"] == 0
    assert quality.dq_pii_columns(f.panel).count() == 0
    assert one(quality.dq_label_binary(f.panel))["is_binary"]
    assert all(r.orphans == 0 for r in quality.dq_foreign_keys(f.t).collect())
