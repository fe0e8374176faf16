"""What happened after an intervention, and the rates derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, parse_risk_tier
from tidemark.session import shuffled

WINDOWS = (7, 14, 30)


def _member_timeline(sent: DataFrame, sessions: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per member and day with what happened on it.

    All three inputs collapse to member-days before the shuffle by member, so a
    member's partition is bounded by calendar days, however active they are.
    """
    paid_fee = (F.col("transaction_type") == "Membership Fee") & (F.col("status") == "Paid")
    rows = [
        sent.select("member_id", F.col("intervention_date").alias("day"), F.lit(1).alias("was_sent")),
        sessions.filter(F.col("attended")).select(
            "member_id", F.to_date("scheduled_at").alias("day"), F.lit(1).alias("visited")),
        transactions.filter(paid_fee).select(
            "member_id", F.col("transaction_date").alias("day"), F.lit(1).alias("paid")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.groupBy("member_id", "day").agg(
        F.max("was_sent").alias("was_sent"), F.max("visited").alias("visited"), F.max("paid").alias("paid")
    )


def _after_sent(timeline: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Visit counts in each (sent, sent + n] window and the first visit and payment after."""
    day_no = F.unix_date("day")
    by_day = W.partitionBy("member_id").orderBy("day_no")
    later = by_day.rangeBetween(1, W.unboundedFollowing)
    df = timeline.withColumn("day_no", day_no)
    return (
        df.withColumns({
            **{
                f"sessions_post_{n}d": F.coalesce(F.sum("visited").over(by_day.rangeBetween(1, n)), F.lit(0))
                for n in windows
            },
            "re_engaged_date": F.min(F.when(F.col("visited") == 1, F.col("day"))).over(later),
            "payment_resolved_date": F.min(F.when(F.col("paid") == 1, F.col("day"))).over(later),
        })
        .filter(F.col("was_sent") == 1)
        .withColumnRenamed("day", "intervention_date")
        .drop("was_sent", "visited", "paid", "day_no")
    )


def intervention_outcomes(
    audit: DataFrame, sessions: DataFrame, transactions: DataFrame, ground_truth: DataFrame,
    *, windows: tuple[int, int, int] = WINDOWS,
) -> DataFrame:
    """Outcome of each delivered intervention in each window.

    Range frames over one timeline per member replace a join of every
    intervention with every later visit.
    """
    sent = audit.filter(F.col("status").isin(C.DELIVERED)).select(
        "audit_id", "member_id", "hashed_member_id",
        F.to_date("sent_at").alias("intervention_date"), "action_type",
        F.coalesce(parse_risk_tier(F.col("why_score")), F.lit("Unknown")).alias("risk_tier"),
    )
    effects = _after_sent(_member_timeline(sent, sessions, transactions), windows)
    fate = ground_truth.select("member_id", "churned", "churn_date")
    rows = (
        sent.join(shuffled(effects), ["member_id", "intervention_date"])
        .join(shuffled(fate), "member_id", "left")
        .withColumn("churned", F.coalesce("churned", F.lit(False)))
    )
    day, churn, paid = F.col("intervention_date"), F.col("churn_date"), F.col("payment_resolved_date")

    def outcome(n: int) -> Column:
        end = F.date_add(day, n)
        return (
            F.when(F.col(f"sessions_post_{n}d") > 0, "re_engaged")
            .when(paid <= end, "payment_resolved")
            .when(F.col("churned") & (churn <= end), "churned")
            .when(~F.col("churned"), "still_active")
            .otherwise("no_response")
        )

    last = F.date_add(day, windows[-1])
    in_window = F.col("churned") & (churn > day) & (churn <= last)
    return rows.select(
        "audit_id", "member_id", "hashed_member_id", "intervention_date", "action_type", "risk_tier",
        *[outcome(n).alias(f"outcome_{n}d") for n in windows],
        "re_engaged_date", "payment_resolved_date",
        F.coalesce(paid <= last, F.lit(False)).alias("payment_resolved_within_30d"),
        *[f"sessions_post_{n}d" for n in windows],
        F.coalesce(in_window, F.lit(False)).alias("churned_within_30d"),
    )


def _positive() -> Column:
    return F.col("outcome_30d").isin(C.POSITIVE_OUTCOMES)


def conversion_rates(outcomes: DataFrame) -> DataFrame:
    """Rates by channel, by tier and by both, in one pass over grouping sets."""
    c = F.col("outcome_30d")
    level = (
        F.when(F.grouping("risk_tier") == 1, "by_channel")
        .when(F.grouping("action_type") == 1, "by_tier")
        .otherwise("by_channel_tier")
    )
    sets = [
        [F.col("action_type")], [F.col("risk_tier")], [F.col("action_type"), F.col("risk_tier")]
    ]
    return outcomes.groupingSets(sets, "action_type", "risk_tier").agg(
        level.alias("grouping"),
        F.count("audit_id").alias("total"),
        count_when(c == "re_engaged").alias("re_engaged"),
        count_when(c == "payment_resolved").alias("payment_resolved"),
        count_when(c == "churned").alias("churned"),
        F.bround(F.avg(_positive().cast("double")), 3).alias("positive_rate"),
    )


def channel_effectiveness(outcomes: DataFrame) -> DataFrame:
    hit = F.sum(_positive().cast("int"))
    total = F.count("audit_id")
    return outcomes.groupBy("action_type").agg(
        total.alias("total"), hit.alias("positive"),
        F.avg(_positive().cast("double")).alias("positive_rate"),
        F.bround(hit / total * 100, 1).alias("rate_pct"),
    )


def outcome_distribution(outcomes: DataFrame) -> DataFrame:
    everyone = W.partitionBy(F.lit(1))
    return outcomes.groupBy("outcome_30d").agg(F.count(F.lit(1)).alias("interventions")).withColumn(
        "pct", F.col("interventions") * 100.0 / F.sum("interventions").over(everyone)
    )
