"""Win-back reactivations, the studio ranking and the bonus pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.operators.revenue import ranked


def observed_reactivations(history: DataFrame) -> DataFrame:
    """Members whose stage went from cancelled to active between consecutive snapshots.

    ``history`` holds one row per member and snapshot. Every member who was ever
    cancelled is listed; ``reactivated`` tells whether a return was seen.
    """
    w = W.partitionBy("hashed_member_id").orderBy("snapshot_date")
    steps = history.withColumn("before", F.lag("stage").over(w))
    back = F.col("before").isin(C.CANCELLED_STAGES) & F.col("stage").isin(C.ACTIVE_STAGES)
    return (
        steps.groupBy("hashed_member_id").agg(
            F.max_by("member_id", "snapshot_date").alias("member_id"),
            F.max_by("home_studio_id", "snapshot_date").alias("home_studio_id"),
            F.max_by("monthly_price", "snapshot_date").alias("monthly_price"),
            F.bool_or(F.col("stage").isin(C.CANCELLED_STAGES)).alias("__was_cancelled"),
            F.coalesce(F.bool_or(back), F.lit(False)).alias("reactivated"),
            F.min(F.when(back, F.col("snapshot_date"))).alias("reactivated_at"),
        )
        .filter("__was_cancelled").drop("__was_cancelled")
    )


def winback_leaderboard(reactivations: DataFrame, *, pool_pct: float = 0.10, months: int = 12) -> DataFrame:
    """Per studio: eligible, reactivated, recovered revenue and the bonus share."""
    hit = F.col("reactivated")
    board = (
        reactivations.filter(F.col("home_studio_id").isNotNull()).groupBy("home_studio_id").agg(
            F.count("member_id").alias("eligible"),
            F.sum(hit.cast("int")).alias("reactivated"),
            F.round(F.sum(F.when(hit, F.col("monthly_price")).otherwise(0.0)), 2).alias("recovered_mrr"),
        )
        .withColumn("reactivation_rate", F.bround(F.col("reactivated") / F.col("eligible"), 3))
        .withColumn("recovered_annual", F.round(F.col("recovered_mrr") * months, 2))
    )
    total = F.sum("recovered_annual").over(W.partitionBy(F.lit(1)))
    board = board.withColumn("__total", total).withColumn(
        "bonus_award",
        F.when(F.col("__total") > 0,
               F.round(F.col("recovered_annual") / F.col("__total") * (F.col("__total") * pool_pct), 2))
        .otherwise(0.0),
    ).drop("__total")
    return ranked(
        board, F.desc("reactivation_rate"), F.desc("recovered_mrr"), F.asc("home_studio_id")
    )


def bonus_pool(board: DataFrame, *, pool_pct: float = 0.10) -> DataFrame:
    total = F.coalesce(F.sum("recovered_annual"), F.lit(0.0))
    return board.agg(
        F.round(total * pool_pct, 2).alias("bonus_pool"),
        F.round(total, 2).alias("total_recovered_annual"),
        F.min_by("home_studio_id", "rank").alias("champion_studio"),
        F.coalesce(F.min_by("reactivation_rate", "rank"), F.lit(0.0)).alias("champion_rate"),
    )


def studio_rank(board: DataFrame, studio_id: str | None = None) -> DataFrame:
    """Standing of one studio, or of all, among the ranked ones."""
    out = board.withColumn("of", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    if studio_id is not None:
        out = out.filter(F.col("home_studio_id") == F.lit(studio_id))
    return out.select(
        "home_studio_id", "rank", "of", "reactivation_rate", "reactivated", "eligible",
        "recovered_mrr", "bonus_award",
    )
