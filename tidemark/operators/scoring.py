"""Risk tiers, at-risk reports and row-level scoping over scored snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import (
    count_when, primary_reason, rank_of, reasons_text, risk_tier,
)

SCORE_KEYS = ["hashed_member_id"]


def latest_snapshot(df: DataFrame, date_col: str) -> DataFrame:
    """Rows of the latest date. The maximum is a scalar subquery, so the date filter
    still reaches the scan and prunes date partitions."""
    return df.filter(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def with_risk_tier(scores: DataFrame) -> DataFrame:
    return scores.withColumn("risk_tier", risk_tier(F.col("churn_probability")))


def scored_features(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Scores joined to the feature row of their own day."""
    return scores.join(
        features.withColumnRenamed("date_day", "score_date"), ["hashed_member_id", "score_date"]
    )


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key. The rank filter is applied before the shuffle as well,
    so a hot key sends one row per task."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key by an explicit order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def last_n_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows per key (rank limit pushed below the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def first_last_days(features: DataFrame, first: int = 5, last: int = 10) -> DataFrame:
    """First and last days of every member's history; short histories are whole.

    The place from the end follows from the number of days, so each member's days are sorted once.
    """
    member = W.partitionBy("hashed_member_id")
    ranked = features.withColumn("day_no", F.row_number().over(member.orderBy("date_day"))).withColumn(
        "from_end", F.count(F.lit(1)).over(member) - F.col("day_no") + 1)
    return ranked.filter((F.col("day_no") <= first) | (F.col("from_end") <= last)).drop("from_end")


def member_lookup(
    identity: DataFrame, features: DataFrame, member_id: str, first: int = 5, last: int = 10
) -> DataFrame:
    """One member's contact row with the start and end of the feature history.

    The member's key is looked up first, so the features are filtered by a constant: a panel that is
    bucketed by the key (``sources.store``) is read in one bucket only. An unknown member has no rows.
    """
    one = identity.filter(F.col("member_id") == F.lit(member_id))
    key = one.select("hashed_member_id").first()
    history = features.filter(F.col("hashed_member_id") == F.lit(key[0] if key else None))
    return first_last_days(one.join(history, "hashed_member_id"), first, last)


def search_members(identity: DataFrame) -> DataFrame:
    return identity.select("member_id", "name").orderBy("name", "member_id")


def scope_to_studio(
    frames: dict[str, DataFrame], studio_id: str | None
) -> dict[str, DataFrame]:
    """Restrict features, identity and scores to one studio.

    Members in scope are those with any feature day in the studio. Reports take
    the returned dict, so a scoped caller has no unscoped frame to read.
    """
    if studio_id is None:
        return dict(frames)
    if not re.fullmatch(r"[A-Za-z0-9_]+", studio_id):
        raise ValueError("invalid studio identifier")
    features = frames["features"].filter(F.col("home_studio_id") == F.lit(studio_id))
    inside = features.select("hashed_member_id").distinct()
    return {
        **frames,
        "features": features,
        "identity": frames["identity"].join(inside, "hashed_member_id", "left_semi"),
        "scores": frames["scores"].join(inside, "hashed_member_id", "left_semi"),
    }


def top_k_at_risk(
    scores: DataFrame, features: DataFrame, identity: DataFrame, k: int = 10
) -> DataFrame:
    """The k riskiest members with contacts and reasons. Only k rows reach the identity join."""
    top = (
        scored_features(scores, features)
        .orderBy(F.desc("churn_probability"), "hashed_member_id")
        .limit(k)
    )
    return top.join(identity, "hashed_member_id").select(
        "hashed_member_id", "member_id", "name", "email", "home_studio_id", "membership_tier",
        "churn_probability", "risk_tier", reasons_text().alias("reasons"),
    )


def priority_actions(
    scores: DataFrame, features: DataFrame, identity: DataFrame, k: int = 5
) -> DataFrame:
    """The k riskiest members at Medium or above with their primary reason."""
    top = (
        scored_features(scores.filter(F.col("risk_tier").isin(C.AT_RISK_TIERS)), features)
        .orderBy(F.desc("churn_probability"), "hashed_member_id")
        .limit(k)
    )
    return top.join(identity, "hashed_member_id", "left").select(
        "hashed_member_id", "member_id", "name", "churn_probability", "risk_tier",
        "membership_tier", "monthly_price", "tenure_days", "days_since_last_session",
        "sessions_attended_30d", primary_reason().alias("primary_reason"),
    )


def demo_member_pick(scores: DataFrame, features: DataFrame) -> DataFrame:
    """The member with a cancel question and the highest probability."""
    return (
        scored_features(scores, latest_snapshot(features, "date_day"))
        .orderBy(F.desc(F.col("has_cancellation_query_30d").cast("int")),
                 F.desc("churn_probability"), "hashed_member_id")
        .limit(1)
        .select("hashed_member_id", "has_cancellation_query_30d", "churn_probability")
    )


def risk_kpis(scores: DataFrame, features: DataFrame, mrr_cut: float = 0.5) -> DataFrame:
    p = F.col("churn_probability")
    return scored_features(scores, features).agg(
        F.countDistinct("hashed_member_id").alias("total_active"),
        count_when(F.col("risk_tier").isin(C.AT_RISK_TIERS)).alias("at_risk"),
        F.sum(p).alias("churn_forecast"),
        F.sum(F.when(p >= mrr_cut, F.col("monthly_price")).otherwise(0.0)).alias("mrr_at_risk"),
    )


def risk_distribution(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("members"))
        .withColumn("tier_order", rank_of(F.col("risk_tier"), C.TIER_ORDER) - 1)
        .orderBy("tier_order")
    )


def risk_histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins; a probability of exactly 1 belongs to the last bin."""
    b = F.least(F.width_bucket("churn_probability", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("members")).orderBy("bin")


def studio_risk_breakdown(scores: DataFrame, features: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    tier = F.col("risk_tier")
    return (
        scored_features(scores, features).groupBy(F.col("home_studio_id").alias("studio")).agg(
            F.countDistinct("hashed_member_id").alias("active_members"),
            count_when(tier == "Critical").alias("critical_count"),
            count_when(tier == "High").alias("high_count"),
            count_when(tier == "Medium").alias("medium_count"),
            F.round(F.avg(p) * 100, 2).alias("avg_risk_pct"),
            F.round(F.sum(p), 1).alias("expected_churn_count"),
        ).orderBy(F.desc("expected_churn_count"), "studio")
    )


def status_filter(df: DataFrame, status: str | list[str] | None = None) -> DataFrame:
    """Queue or audit rows of the given statuses; None or 'All' keeps every row."""
    if status is None or status == "All":
        return df
    return df.filter(F.col("status").isin([status] if isinstance(status, str) else status))
