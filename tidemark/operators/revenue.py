"""Revenue attribution, channel return, leaderboards and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.operators.scoring import dedup_first


def channel_cost(
    action_type: Column, costs: dict[str, float] = C.CHANNEL_COSTS,
    default: float = C.DEFAULT_CHANNEL_COST,
) -> Column:
    """Cost of one send as an exact decimal, so that sums do not depend on row order."""
    (first, price), *rest = costs.items()
    chain = F.when(action_type == first, price)
    for name, value in rest:
        chain = chain.when(action_type == name, value)
    return chain.otherwise(default).cast("decimal(12,4)")


def avg_lifetime_months(
    members: DataFrame, ground_truth: DataFrame, *, days_per_month: float = C.DAYS_PER_MONTH,
    fallback: float = C.FALLBACK_LIFETIME_MONTHS,
) -> DataFrame:
    """Mean months from joining to churn over churned members (one row)."""
    days = F.datediff("churn_date", "join_date")
    return (
        members.select("member_id", "join_date")
        .join(ground_truth.filter(F.col("churned")).select("member_id", "churn_date"), "member_id")
        .agg(F.coalesce(
            F.bround(F.avg(F.when(days > 0, days)) / days_per_month, 1), F.lit(fallback)
        ).alias("avg_lifetime_months"))
    )


def _one_lifecycle_row(lifecycle: DataFrame) -> DataFrame:
    return dedup_first(lifecycle, ["hashed_member_id"], [F.desc("snapshot_date"), F.asc("stage")])


def treated_members(
    outcomes: DataFrame, lifecycle: DataFrame, *,
    retention_effectiveness: float = C.RETENTION_EFFECTIVENESS,
    winback_effectiveness: float = C.WINBACK_EFFECTIVENESS,
) -> DataFrame:
    """One row per treated member with touches, channel and expected revenue effect.

    The primary channel is the most used one, ties to the smallest name.
    """
    touched = outcomes.groupBy("hashed_member_id").agg(
        F.count("audit_id").alias("touches"),
        F.bool_or(F.coalesce("churned_within_30d", F.lit(False))).alias("is_lost"),
        F.bool_or(F.col("outcome_30d").isin(C.SAVED_OUTCOMES)).alias("confirmed_save"),
        F.mode("action_type", True).alias("primary_channel"),
    )
    life = _one_lifecycle_row(lifecycle).select(
        "hashed_member_id", "monthly_price", "home_studio_id", "churn_probability", "stage"
    )
    returning = F.col("stage").isin(C.CANCELLED_STAGES)
    return (
        touched.join(life, "hashed_member_id", "left")
        .fillna({"monthly_price": 0.0, "churn_probability": 0.0, "stage": "unknown"})
        .withColumn("segment", F.when(returning, "reactivation").otherwise("retention"))
        .withColumn("effectiveness", F.when(returning, winback_effectiveness)
                    .otherwise(retention_effectiveness))
        .withColumn("targeted_mrr", F.col("churn_probability") * F.col("monthly_price"))
        .withColumn("saved_mrr", F.col("targeted_mrr") * F.col("effectiveness"))
        .withColumn("saved_members_exp", F.col("churn_probability") * F.col("effectiveness"))
        .withColumn("lost_mrr", F.when(F.col("is_lost"), F.col("monthly_price")).otherwise(0.0))
    )


def revenue_summary(
    outcomes: DataFrame, treated: DataFrame, lifetime: DataFrame, *,
    costs: dict[str, float] = C.CHANNEL_COSTS,
    retention_effectiveness: float = C.RETENTION_EFFECTIVENESS,
    winback_effectiveness: float = C.WINBACK_EFFECTIVENESS,
) -> DataFrame:
    """Programme totals (one row)."""
    spend = outcomes.agg(
        F.coalesce(F.sum(channel_cost(F.col("action_type"), costs)).cast("double"), F.lit(0.0))
    ).scalar()
    months = lifetime.select("avg_lifetime_months").scalar()
    totals = treated.agg(
        F.countDistinct("hashed_member_id").alias("members_treated"),
        F.sum("saved_members_exp").alias("__saved_members"),
        F.sum(F.col("confirmed_save").cast("int")).alias("confirmed_reengaged"),
        F.sum(F.col("is_lost").cast("int")).alias("members_lost"),
        F.sum("targeted_mrr").alias("__risk"),
        F.sum("saved_mrr").alias("__saved"),
        F.sum("lost_mrr").alias("__lost"),
    ).withColumns({"__spend": spend, "avg_lifetime_months": months})
    c = F.col
    net = c("__saved") - c("__spend")
    return totals.select(
        "members_treated",
        F.round("__saved_members", 1).alias("est_members_saved"),
        "confirmed_reengaged", "members_lost",
        F.round("__risk", 2).alias("mrr_at_risk"),
        F.round("__saved", 2).alias("saved_mrr"),
        F.round("__lost", 2).alias("lost_mrr"),
        F.round("__spend", 2).alias("intervention_spend"),
        F.round(net, 2).alias("net_monthly_impact"),
        "avg_lifetime_months",
        F.round(c("__saved") * c("avg_lifetime_months"), 2).alias("ltv_impact"),
        F.lit(retention_effectiveness).alias("retention_effectiveness"),
        F.lit(winback_effectiveness).alias("winback_rate"),
        F.when(c("__spend") > 0, F.round(net / c("__spend"), 1)).alias("roi_ratio"),
    )


def channel_roi(
    outcomes: DataFrame, treated: DataFrame, *, costs: dict[str, float] = C.CHANNEL_COSTS
) -> DataFrame:
    """Per channel: sends, cost and the saved revenue of members it reached most."""
    cost = outcomes.groupBy(F.col("action_type").alias("channel")).agg(
        F.count(F.lit(1)).alias("sends"),
        F.round(F.sum(channel_cost(F.col("action_type"), costs)), 2).cast("double").alias("cost"),
    )
    saved = treated.groupBy(F.col("primary_channel").alias("channel")).agg(
        F.round(F.sum("saved_members_exp"), 1).alias("members_saved"),
        F.round(F.sum("saved_mrr"), 2).alias("saved_mrr"),
    )
    net = F.col("saved_mrr") - F.col("cost")
    return (
        cost.join(saved, "channel", "left")
        .fillna({"members_saved": 0.0, "saved_mrr": 0.0})
        .withColumn("net_monthly", F.round(net, 2))
        .withColumn("roi_ratio", F.when(F.col("cost") > 0, F.round(net / F.col("cost"), 1)))
    )


def ranked(board: DataFrame, *order: Column) -> DataFrame:
    """Number a per-studio table. It has one row per studio, a dimension-sized result."""
    return board.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


def studio_leaderboard(
    outcomes: DataFrame, treated: DataFrame, lifecycle: DataFrame, *,
    costs: dict[str, float] = C.CHANNEL_COSTS,
) -> DataFrame:
    """Per studio economics ranked by net; members without a studio are left out."""
    home = _one_lifecycle_row(lifecycle).select("hashed_member_id", "home_studio_id")
    per_member = outcomes.groupBy("hashed_member_id").agg(
        F.sum(channel_cost(F.col("action_type"), costs)).alias("cost")
    )
    spend = (
        per_member.join(home, "hashed_member_id", "left")
        .groupBy("home_studio_id").agg(F.sum("cost").alias("__spend"))
    )
    board = (
        treated.filter(F.col("home_studio_id").isNotNull()).groupBy("home_studio_id").agg(
            F.countDistinct("hashed_member_id").alias("members_treated"),
            F.round(F.sum("saved_members_exp"), 2).alias("est_saved"),
            F.sum(F.col("is_lost").cast("int")).alias("members_lost"),
            F.round(F.sum("targeted_mrr"), 2).alias("mrr_at_risk"),
            F.round(F.sum("saved_mrr"), 2).alias("saved_mrr"),
            F.round(F.sum("lost_mrr"), 2).alias("lost_mrr"),
        )
        .join(spend, "home_studio_id", "left")
        .withColumn("spend", F.coalesce(F.round("__spend", 2).cast("double"), F.lit(0.0)))
        .withColumn("net_monthly", F.round(F.col("saved_mrr") - F.col("spend"), 2))
        .drop("__spend")
    )
    return ranked(board, F.desc("net_monthly"), F.asc("home_studio_id"))


def km_retention(
    members: DataFrame, ground_truth: DataFrame, *, as_of: Column, max_months: int = 36,
    days_per_month: float = C.DAYS_PER_MONTH,
) -> DataFrame:
    """Product-limit retention per month since joining.

    One pass counts members by whole months lived; everything after works on at
    most ``max_months + 1`` rows.
    """
    spark = members.sparkSession
    churned = F.coalesce("churned", F.lit(False))
    end = F.when(churned, F.col("churn_date")).otherwise(as_of)
    months = F.greatest(F.datediff(end, F.col("join_date")) / days_per_month, F.lit(0.0))
    lived = (
        members.select("member_id", "join_date")
        .join(ground_truth.select("member_id", "churned", "churn_date"), "member_id")
        .filter(end.isNotNull())
        .groupBy((F.least(F.floor(months), F.lit(max_months)) + 1).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(churned.cast("int")).alias("gone"))
    )
    axis = spark.range(1, max_months + 2).select(F.col("id").alias("month"))
    forward = W.partitionBy(F.lit(1)).orderBy("month")
    backward = W.partitionBy(F.lit(1)).orderBy(F.desc("month")).rowsBetween(W.unboundedPreceding, 0)
    hist = axis.join(lived, "month", "left").fillna(0, ["n", "gone"])
    at_risk = hist.withColumn("at_risk", F.sum("n").over(backward))
    step = F.when(F.col("at_risk") > 0, 1 - F.col("gone") / F.col("at_risk")).otherwise(1.0)
    return (
        at_risk.withColumn("step", step)
        .withColumn("retention", F.round(
            F.product("step").over(forward.rowsBetween(W.unboundedPreceding, 0)), 4))
        .filter(F.col("month") <= max_months)
        .select("month", "retention", "at_risk")
        .orderBy("month")
    )
