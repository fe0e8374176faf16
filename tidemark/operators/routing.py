"""Campaign routing: holdout, cooldown, escalation, send cap and the three routers.

Routers are pure column logic over joined frames. They return one decision row
per evaluated member; ``queue_rows`` and ``audit_rows`` project the two tables
to append. Ids derive from the run id and the member hash, so a retried task
writes the same ids.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, in_holdout
from tidemark.session import checkpointed, shuffled

ESCALATION = {"Email": "SMS", "SMS": "Call"}


def at(now) -> Column:
    """A point in time as a zone-less timestamp column."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def _back(now, **parts: int) -> Column:
    return at(now) - F.make_dt_interval(*[F.lit(parts.get(k, 0)) for k in ("days", "hours", "mins")])


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Concatenate a template with its {placeholders} replaced by columns; nulls become ''."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{"):
            parts.append(F.coalesce(fields[piece[1:-1]].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


# --- rules ---------------------------------------------------------------------

def holdout_assignment(df: DataFrame, *, salt: str, modulus: int = 10) -> DataFrame:
    return df.withColumn("is_holdout", in_holdout(F.col("member_id"), salt, modulus))


def recently_messaged(audit: DataFrame, now, days: int = 7) -> DataFrame:
    """Distinct members with a delivered message inside the cooldown."""
    return (
        audit.filter(F.col("status").isin(C.DELIVERED) & (F.col("sent_at") >= _back(now, days=days)))
        .select("hashed_member_id").distinct()
    )


def cooldown_filter(candidates: DataFrame, audit: DataFrame, *, now, days: int = 7) -> DataFrame:
    """Candidates without a recent message."""
    return candidates.join(shuffled(recently_messaged(audit, now, days)), "hashed_member_id", "left_anti")


def sends_last_hour(audit: DataFrame, now) -> DataFrame:
    return audit.filter(F.col("sent_at") >= _back(now, hours=1)).groupBy("action_type").agg(
        F.count(F.lit(1)).alias("sends")
    )


def prior_hour_sent(audit: DataFrame, now) -> Column:
    """Number of live sends in the hour before ``now`` (a scalar)."""
    return audit.filter(
        (F.col("sent_at") >= _back(now, hours=1)) & (F.col("status") == "Sent")
    ).agg(F.count(F.lit(1))).scalar()


def channel_escalation(default: Column, rates: DataFrame | None, *, threshold: float = 0.10) -> Column:
    """Move one step up when the channel's positive rate is known and below the threshold."""
    if rates is None:
        return default

    known = rates.filter(F.col("action_type").isin(list(ESCALATION))).groupBy("action_type").agg(
        F.max("positive_rate").alias("rate")
    ).agg(F.map_from_entries(F.collect_list(F.struct("action_type", "rate")))).scalar()

    def rate(channel: str) -> Column:
        return F.coalesce(F.try_element_at(known, F.lit(channel)), F.lit(1.0))

    chain = None
    for channel, higher in ESCALATION.items():
        test = (default == channel) & (rate(channel) < threshold)
        chain = F.when(test, higher) if chain is None else chain.when(test, higher)
    return chain.otherwise(default)


def send_cap(
    actions: DataFrame, *, prior: Column, cap: int = 50, value: str = "risk_score",
    tiebreak: str = "hashed_member_id", counted: str = "counts_to_cap",
) -> DataFrame:
    """Rows before the first counted row that would exceed the cap.

    Order is ``value`` descending, then ``tiebreak``. Everything after the
    breach stops, whatever its kind; the breach row itself stays, marked
    ``halted``. At most ``cap + 1`` counted rows can precede the breach, so a
    distributed top-k finds it and no global window is needed.
    """
    first = (
        actions.filter(F.col(counted))
        .orderBy(F.desc(value), F.asc(tiebreak)).limit(cap + 1)
        .select(value, tiebreak)
    )
    numbered = first.withColumn(
        "__n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(value), F.asc(tiebreak)))
    ).withColumn("__breach", F.greatest(cap - prior, F.lit(0)) + 1)
    breach = numbered.filter(F.col("__n") == F.col("__breach")).agg(
        F.max(F.struct(F.col(value).alias("v"), F.col(tiebreak).alias("t")))
    ).scalar()
    marked = actions.withColumn("__b", breach)
    v, t = F.col("__b.v"), F.col("__b.t")
    keep = F.col("__b").isNull() | (F.col(value) > v) | ((F.col(value) == v) & (F.col(tiebreak) <= t))
    return (
        marked.filter(keep)
        .withColumn("halted", F.col("__b").isNotNull() & (F.col(tiebreak) == t) & (F.col(value) == v))
        .drop("__b")
    )


# --- projections -----------------------------------------------------------------

def _action_id(prefix: str, run_id: str) -> Column:
    return F.concat(F.lit(prefix + run_id), F.substring("hashed_member_id", 1, 16))


def queue_rows(decisions: DataFrame, *, run_id: str, now, prefix: str = "AC") -> DataFrame:
    """Queue table rows: everything that was decided and not halted."""
    stamp = at(now)
    return decisions.filter(F.col("status").isNotNull()).select(
        _action_id(prefix, run_id).alias("action_id"), "member_id", "hashed_member_id",
        "home_studio_id", "score_date", "risk_score", "risk_tier", "action_type",
        "action_details", "status", stamp.alias("created_at"),
        F.when(F.col("status") != "Pending", stamp).alias("processed_at"),
    )


def audit_rows(decisions: DataFrame, *, run_id: str, now, prefix: str = "AU") -> DataFrame:
    """Audit table rows: as the queue, without rate-limited members."""
    return decisions.filter(F.col("status").isNotNull() & (F.col("status") != "RateLimited")).select(
        _action_id(prefix, run_id).alias("audit_id"), "member_id", "hashed_member_id",
        at(now).alias("sent_at"), "action_type", "status", "why_score", "message_body",
        F.lit("").alias("error_message"),
    )


def dispatch_stats(decisions: DataFrame) -> DataFrame:
    """Counts per outcome of one router run (one row)."""
    s = F.col("status")
    zero = F.lit(0)

    def n(cond: Column, name: str) -> Column:
        return F.coalesce(count_when(cond), zero).alias(name)

    return decisions.agg(
        F.count(F.lit(1)).alias("evaluated"),
        n(F.col("action_type").isNull(), "no_action"),
        n(s == "Holdout", "holdout"),
        n(s == "RateLimited", "rate_limited"),
        n(s.isin("Sent", "DryRun"), "sent"),
        n(s == "Pending", "pending"),
        n(s == "Failed", "failed"),
        n(F.col("escalated"), "escalated"),
    )


def _capped(decisions: DataFrame, audit: DataFrame, now, live: bool, cap: int | None) -> DataFrame:
    """Live decisions up to the cap; ``None`` sets none. Decisions are made once, then read twice."""
    if not live or cap is None:
        return decisions
    out = send_cap(checkpointed(decisions), prior=prior_hour_sent(audit, now), cap=cap)
    return out.withColumn("status", F.when(~F.col("halted"), F.col("status"))).drop("halted")


# --- routers -----------------------------------------------------------------------

# Action and message wording of the churn router.
CHURN_ACTIONS = {
    "Medium": (
        "Email", "Send: Re-engagement promotions & new class highlights email.",
        "Hi {name}, we noticed you haven't booked a session lately! Check out our new virtual "
        "trainers and book a slot today.",
    ),
    "High": (
        "SMS", "Send: Push notification or personal SMS.",
        "Hey {name}! It's your coach at {brand}. We miss you in the sauna! Here's a voucher for a "
        "free retail recovery drink on your next session: {voucher}.",
    ),
    "Critical": (
        "Call", "Action: Studio staff personal outreach call required immediately.",
        "URGENT: Call {name} ({phone}) to resolve account issues (e.g. failed payment or "
        "cancellation inquiries).",
    ),
}


def _by_key(key: Column, values: dict[str, Column]) -> Column:
    (first, value), *rest = values.items()
    chain = F.when(key == first, value)
    for name, item in rest:
        chain = chain.when(key == name, item)
    return chain


def _with_cooldown(df: DataFrame, audit: DataFrame, now, days: int) -> DataFrame:
    recent = recently_messaged(audit, now, days).withColumn("in_cooldown", F.lit(True))
    return df.join(shuffled(recent), "hashed_member_id", "left").withColumn(
        "in_cooldown", F.coalesce("in_cooldown", F.lit(False))
    )


def route_churn_actions(
    scores: DataFrame, identity: DataFrame, features: DataFrame, audit: DataFrame,
    rates: DataFrame | None, *, now, holdout_salt: str, live: bool = False, cap: int | None = 50,
    cooldown_days: int = 7, threshold: float = 0.10, default_studio: str = "S01",
    brand: str = "your studio", voucher: str = "RECOVERY",
) -> DataFrame:
    """Decisions for the latest scores: tier action, escalation, holdout, cooldown, cap."""
    tier = F.col("risk_tier")
    texts = {"name": F.col("name"), "phone": F.col("phone"), "brand": F.lit(brand),
             "voucher": F.lit(voucher)}
    home = features.select(
        "hashed_member_id", F.col("date_day").alias("score_date"), "home_studio_id"
    ).distinct()
    base = (
        scores.join(shuffled(identity), "hashed_member_id")
        .join(shuffled(home), ["hashed_member_id", "score_date"], "left")
        .withColumns({
            "default_type": _by_key(tier, {k: F.lit(v[0]) for k, v in CHURN_ACTIONS.items()}),
            "details": _by_key(tier, {k: F.lit(v[1]) for k, v in CHURN_ACTIONS.items()}),
            "message_body": _by_key(tier, {k: fill(v[2], texts) for k, v in CHURN_ACTIONS.items()}),
        })
        .withColumn("action_type", channel_escalation(F.col("default_type"), rates, threshold=threshold))
    )
    base = holdout_assignment(_with_cooldown(base, audit, now, cooldown_days), salt=holdout_salt)
    action = F.col("action_type")
    limited = action.isin("Email", "SMS", "Push") & F.col("in_cooldown")
    status = (
        F.when(action.isNull(), None)
        .when(F.col("is_holdout"), "Holdout")
        .when(limited, "RateLimited")
        .when(action == "Call", "Pending")
        .otherwise("Sent" if live else "DryRun")
    )
    escalated = action != F.col("default_type")
    decisions = base.withColumn("status", status).select(
        "hashed_member_id", "member_id",
        F.coalesce("home_studio_id", F.lit(default_studio)).alias("home_studio_id"),
        "score_date", F.col("churn_probability").alias("risk_score"), "risk_tier", "action_type",
        F.concat(
            F.when(escalated, F.concat(F.lit("[ESCALATED from "), "default_type", F.lit("] ")))
            .otherwise(""),
            "details",
            F.when(F.col("status") == "Holdout", " (Holdout Group: Untreated)")
            .when(F.col("status") == "RateLimited", " (Rate Limited: Skipped)").otherwise(""),
        ).alias("action_details"),
        "status",
        F.concat(F.lit("Score: "), F.format_string("%.4f", "churn_probability"),
                 F.lit(" | Tier: "), "risk_tier").alias("why_score"),
        "message_body",
        F.coalesce(escalated, F.lit(False)).alias("escalated"),
        F.coalesce(action.isin("Email", "SMS") & (F.col("status") == "Sent"), F.lit(False))
        .alias("counts_to_cap"),
    )
    return _capped(decisions, audit, now, live, cap)


# Action and message wording of the lifecycle router.
ONBOARDING_STEPS = [
    (3, "Onboarding Day 1-3: Welcome email with first session booking CTA.",
     "Welcome to the {brand} family, {name}! Your infrared sauna journey starts now. Book your "
     "first session today and experience the burn! Tip: start with Hot Yoga or Hot Pilates for a "
     "great first experience."),
    (7, "Onboarding Day 4-7: First-week check-in + session reminder.",
     "Hey {name}, how was your first week at {brand}? If you haven't booked yet, now's the perfect "
     "time! Members who attend 3+ sessions in their first month are 5x more likely to achieve "
     "their fitness goals. Let's get started!"),
    (14, "Onboarding Day 8-14: Habit formation nudge + app feature highlight.",
     "Hi {name}, you're building a great routine! Did you know the {brand} app tracks your workout "
     "metrics in real-time? Check your performance stats after your next session and watch your "
     "progress grow."),
]
WINBACK_STEPS = [
    (14, "WinBackEmail", "Win-Back (Early): 'We miss you' email with limited-time rejoin offer.",
     "Hey {name}, we noticed you left the {brand} family and we miss you! Come back and get your "
     "first month FREE — no rejoin fee. This offer expires in 14 days. Book a complimentary "
     "session to see what's new!"),
    (45, "WinBackSMS", "Win-Back (Mid): SMS with upgraded offer + studio-specific promotion.",
     "{name}, your {brand} studio misses you! Rejoin this week: first month free + complimentary "
     "retail recovery pack. Text REJOIN to get started."),
    (None, "WinBackEmail", "Win-Back (Late): Final re-engagement attempt with best offer.",
     "Hi {name}, this is our last check-in. We'd love to welcome you back to {brand} with our best "
     "offer yet: 50% off your first 2 months + waived rejoin fee. Your infrared sauna is waiting!"),
]


def route_lifecycle_actions(
    lifecycle: DataFrame, identity: DataFrame, audit: DataFrame, *, now, live: bool = False,
    cooldown_days: int = 7, default_studio: str = "S01", brand: str = "your studio",
) -> DataFrame:
    """Onboarding drip and win-back campaign. Members in cooldown get no record at all."""
    people = identity.select("hashed_member_id", F.col("member_id").alias("__id"), "name")
    stage, tenure = F.col("stage"), F.col("tenure_days")
    texts = {"name": F.coalesce("name", F.lit("Member")), "brand": F.lit(brand)}
    welcome = (stage == "onboarding") & (tenure <= ONBOARDING_STEPS[-1][0])
    gone = stage == "win_back_eligible"
    age = F.coalesce("days_in_stage", F.lit(0))

    def choose(pick) -> Column:
        chain = None
        for limit, *rest in ONBOARDING_STEPS:
            cond = welcome & (tenure <= limit)
            value = pick(["OnboardingEmail", *rest])
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        for limit, *rest in WINBACK_STEPS:
            cond = gone if limit is None else gone & (age <= limit)
            chain = chain.when(cond, pick(rest))
        return chain

    candidates = lifecycle.filter(welcome | gone)
    return (
        cooldown_filter(candidates, audit, now=now, days=cooldown_days)
        .join(shuffled(people), "hashed_member_id", "left")
        .select(
            "hashed_member_id", F.coalesce("member_id", "__id").alias("member_id"),
            F.coalesce("home_studio_id", F.lit(default_studio)).alias("home_studio_id"),
            F.col("snapshot_date").alias("score_date"),
            F.col("churn_probability").alias("risk_score"), "risk_tier",
            choose(lambda r: F.lit(r[0])).alias("action_type"),
            choose(lambda r: F.lit(r[1])).alias("action_details"),
            F.lit("Sent" if live else "DryRun").alias("status"),
            F.concat(F.lit("Lifecycle: "), stage, F.lit(" | Tenure: "),
                     tenure.cast("string"), F.lit("d")).alias("why_score"),
            choose(lambda r: fill(r[2], texts)).alias("message_body"),
            F.lit(False).alias("escalated"),
        )
    )


# Segment campaigns.
SEGMENT_CAMPAIGNS = {
    "upsell_candidate": (
        "UpsellEmail", "Pitch VIP/Premium upgrade to a highly-engaged Basic member.",
        "Hi {name}, you're crushing your workouts on the {tier} plan! Members like you get the most "
        "from VIP — unlimited priority booking and exclusive sessions. Upgrade this week and your "
        "first month is 50% off."),
    "under_engaged_payer": (
        "WinValueEmail", "Re-engage / right-size a low-usage Premium member.",
        "Hi {name}, your {tier} membership unlocks our full studio — and we've missed you! Let's get "
        "you back on track: reply and we'll build you a simple 2-sessions-a-week plan (or help you "
        "find the plan that fits)."),
    "at_risk_silent": (
        "EngageNudge", "Proactive nudge to a silent, low-engagement member.",
        "Hi {name}, it's been a while! New virtual trainers and classes just dropped. Book your "
        "comeback session and we'll have a recovery drink waiting."),
    "champion": (
        "ReferralEmail", "Referral / promoter ask to a highly-engaged member.",
        "Hi {name}, you're a {brand} champion! Refer a friend and you BOTH get a free month. Share "
        "your code and keep the streak going."),
}


def route_segment_actions(
    engagement: DataFrame, identity: DataFrame, audit: DataFrame, *, now, holdout_salt: str,
    live: bool = False, cap: int | None = 50, cooldown_days: int = 7, default_studio: str = "S01",
    brand: str = "your studio",
) -> DataFrame:
    """Segment campaigns with holdout, then cooldown, then cap."""
    segment, score = F.col("segment"), F.col("engagement_score").cast("string")
    texts = {"name": F.col("name"), "tier": F.col("membership_tier"), "brand": F.lit(brand)}
    base = engagement.join(shuffled(identity), "hashed_member_id").withColumns({
        "action_type": _by_key(segment, {k: F.lit(v[0]) for k, v in SEGMENT_CAMPAIGNS.items()}),
        "details": _by_key(segment, {k: F.lit(v[1]) for k, v in SEGMENT_CAMPAIGNS.items()}),
        "body": _by_key(segment, {k: fill(v[2], texts) for k, v in SEGMENT_CAMPAIGNS.items()}),
    })
    base = holdout_assignment(_with_cooldown(base, audit, now, cooldown_days), salt=holdout_salt)
    status = (
        F.when(F.col("action_type").isNull(), None)
        .when(F.col("is_holdout"), "Holdout")
        .when(F.col("in_cooldown"), "RateLimited")
        .otherwise("Sent" if live else "DryRun")
    )
    decisions = base.withColumn("status", status).select(
        "hashed_member_id", "member_id",
        F.coalesce("home_studio_id", F.lit(default_studio)).alias("home_studio_id"),
        F.to_date(at(now)).alias("score_date"),
        F.coalesce("churn_probability", F.lit(0.0)).alias("risk_score"),
        segment.alias("risk_tier"), "action_type",
        F.concat(F.lit("["), segment, F.lit("] eng="), score, F.lit(": "), "details").alias("action_details"),
        "status",
        F.concat(F.lit("Engagement "), score, F.lit(" | Segment: "), segment).alias("why_score"),
        F.when(F.col("status") == "Holdout", "").otherwise(F.col("body")).alias("message_body"),
        F.lit(False).alias("escalated"),
        F.coalesce(F.col("status") == "Sent", F.lit(False)).alias("counts_to_cap"),
    )
    return _capped(decisions, audit, now, live, cap)
