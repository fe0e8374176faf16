"""Engagement scores, segments and tier checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import clip, count_when
from tidemark.operators.scoring import latest_snapshot

COMPONENTS = list(C.ENGAGEMENT_WEIGHTS)


def _share(column: str, target: float) -> Column:
    raw = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(0.0)) / target, F.lit(1.0)) * 100


def engagement_score(
    features: DataFrame, scores: DataFrame, *, weights: dict[str, float] = C.ENGAGEMENT_WEIGHTS,
    sessions_target: float = 12.0, logins_target: float = 20.0, retail_target: float = 50.0,
    consistency_days: float = 30.0, as_of: Column | None = None,
) -> DataFrame:
    """Weighted 0-100 score per member with the churn score beside it, at ``as_of`` or the latest day of each."""
    def at_day(df: DataFrame, date_col: str) -> DataFrame:
        return latest_snapshot(df, date_col) if as_of is None else df.filter(F.col(date_col) == as_of)

    idle = F.coalesce(F.col("days_since_last_session"), F.lit(C.NEVER_ATTENDED_DAYS))
    parts = {
        "session_utilization": _share("sessions_attended_30d", sessions_target),
        "app_usage": _share("app_logins_30d", logins_target),
        "email_response": clip(F.coalesce("email_open_rate_30d", F.lit(0.0)), 0.0, 1.0) * 100,
        "retail_spend": _share("retail_spend_30d", retail_target),
        "consistency": clip(1 - idle / consistency_days, 0.0, 1.0) * 100,
    }
    total = reduce(lambda a, b: a + b, [F.lit(weights[n]) * parts[n] for n in COMPONENTS])
    latest_scores = at_day(scores, "score_date").select(
        "hashed_member_id", "churn_probability", "risk_tier"
    )
    return (
        at_day(features, "date_day")
        .select(
            "hashed_member_id", "home_studio_id", "membership_tier", "monthly_price",
            F.bround(total, 1).alias("engagement_score"),
            *[F.bround(parts[n], 1).alias(n) for n in COMPONENTS],
        )
        .join(latest_scores, "hashed_member_id", "left")
        .withColumn("segment", engagement_segment())
    )


def engagement_segment(
    *, high: float = 70, champion: float = 75, low: float = 40, silent: float = 25
) -> Column:
    score, tier = F.col("engagement_score"), F.col("membership_tier")
    return (
        F.when((tier == "Basic") & (score >= high), "upsell_candidate")
        .when((tier == "Premium") & (score < low), "under_engaged_payer")
        .when(score < silent, "at_risk_silent")
        .when(score >= champion, "champion")
        .otherwise("engaged")
    )


def segment_summary(engagement: DataFrame, digits: int = 2) -> DataFrame:
    return (
        engagement.groupBy("segment").agg(
            F.count("hashed_member_id").alias("members"),
            F.bround(F.round(F.avg("engagement_score"), 9), digits).alias("avg_engagement"),
            F.bround(F.round(F.avg("churn_probability"), 9), digits).alias("avg_churn_risk"),
            F.bround(F.sum("monthly_price"), digits).alias("monthly_revenue"),
        ).orderBy(F.desc("members"), "segment")
    )


def engagement_quadrant(engagement: DataFrame, split: float = 50) -> DataFrame:
    """Members per quadrant of engagement score and churn percentage."""
    keen = F.col("engagement_score") >= split
    risky = F.coalesce("churn_probability", F.lit(0.0)) * 100 >= split
    # Quadrant labels.
    label = (
        F.when(risky & ~keen, "CRITICAL OUTREACH")
        .when(risky & keen, "VULNERABLE ENGAGED")
        .when(~risky & ~keen, "UNDER-ENGAGED / PASSIVE")
        .otherwise("HEALTHY / CHAMPIONS")
    )
    return engagement.groupBy(label.alias("quadrant")).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("monthly_price").alias("monthly_revenue"),
    )


def tier_mismatch_check(engagement: DataFrame) -> DataFrame:
    """Upsell candidates must be Basic, under-engaged payers Premium; plus the upsell revenue."""
    up = F.col("segment") == "upsell_candidate"
    under = F.col("segment") == "under_engaged_payer"
    tier = F.col("membership_tier")
    true = F.lit(True)
    return engagement.agg(
        count_when(up).alias("upsell_members"),
        F.coalesce(F.bool_and(F.when(up, tier == "Basic")), true).alias("upsell_all_basic"),
        count_when(under).alias("under_engaged_members"),
        F.coalesce(F.bool_and(F.when(under, tier == "Premium")), true).alias("under_all_premium"),
        F.sum(F.when(up, F.col("monthly_price")).otherwise(0.0)).alias("upsell_pipeline_mrr"),
    )
