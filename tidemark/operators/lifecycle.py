"""Lifecycle stages, transitions and stage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, rank_of
from tidemark.operators.scoring import dedup_first
from tidemark.session import shuffled


def stage_of(
    cancelled: Column, days_gone: Column, *, grace_days: int = 7, winback_days: int = 90,
    onboarding_days: int = 30, idle_days: int = 30,
) -> Column:
    """Stage by fixed precedence. A null or negative age of the cancellation is 'cancelled'."""
    return (
        F.when(cancelled & (days_gone.isNull() | (days_gone < grace_days)), "cancelled")
        .when(cancelled & (days_gone <= winback_days), "win_back_eligible")
        .when(cancelled, "win_back_expired")
        .when(F.col("tenure_days") <= onboarding_days, "onboarding")
        .when((F.col("sessions_attended_30d") == 0)
              & (F.col("days_since_last_session") > idle_days), "lapsed")
        .when(F.col("risk_tier").isin(C.AT_RISK_TIERS), "at_risk")
        .otherwise("engaged")
    )


def lifecycle_stage(
    snapshot: DataFrame, scores: DataFrame, ground_truth: DataFrame, memberships: DataFrame,
    identity: DataFrame, *, as_of: Column, **limits,
) -> DataFrame:
    """Stage of every active member and every known cancelled member.

    ``snapshot`` and ``scores`` hold the as-of day. A cancelled member is one
    the ground truth calls churned, who has an identity and no active row.
    """
    names = identity.select("hashed_member_id", "member_id")
    active = snapshot.join(
        shuffled(scores.select("hashed_member_id", "churn_probability", "risk_tier")), "hashed_member_id", "left"
    ).select(
        "hashed_member_id", F.lit(True).alias("is_active"), F.col("home_studio_id").alias("a_studio"),
        F.col("monthly_price").alias("a_price"), "tenure_days", "risk_tier", "churn_probability",
        "sessions_attended_30d", "days_since_last_session",
    )
    plan = dedup_first(memberships, ["member_id"], [F.asc("membership_id")]).select(
        "member_id", F.col("studio_id").alias("g_studio"), F.col("monthly_price").alias("g_price")
    )
    fate = ground_truth.select("member_id", "churned", "churn_date")
    known = names.join(shuffled(fate), "member_id", "left").join(shuffled(plan), "member_id", "left")
    # One outer join decides active or cancelled, so the snapshot is computed once.
    rows = active.join(shuffled(known), "hashed_member_id", "full_outer").filter(
        F.col("is_active") | F.col("churned")
    )
    here = F.col("is_active").isNotNull()

    def pick(if_active: Column, if_cancelled) -> Column:
        other = if_cancelled if isinstance(if_cancelled, Column) else F.lit(if_cancelled)
        return F.when(here, if_active).otherwise(other)

    c = F.col
    return rows.select(
        "hashed_member_id", "member_id",
        pick(c("a_studio"), c("g_studio")).alias("home_studio_id"),
        pick(c("a_price"), F.coalesce("g_price", F.lit(0.0))).alias("monthly_price"),
        pick(c("tenure_days"), 0).alias("tenure_days"),
        pick(F.coalesce("risk_tier", F.lit("Low")), "N/A").alias("risk_tier"),
        pick(F.coalesce("churn_probability", F.lit(0.0)), 1.0).alias("churn_probability"),
        pick(c("sessions_attended_30d"), 0).alias("sessions_attended_30d"),
        pick(c("days_since_last_session"), C.NEVER_ATTENDED_DAYS).cast("long").alias("days_since_last_session"),
        (~here).alias("gone"),
        F.datediff(as_of, c("churn_date")).alias("days_gone"),
        as_of.alias("snapshot_date"),
    ).select(
        "hashed_member_id", "member_id",
        stage_of(c("gone"), c("days_gone"), **limits).alias("stage"),
        "home_studio_id", "monthly_price", "tenure_days", "risk_tier", "churn_probability",
        "sessions_attended_30d", "days_since_last_session", "snapshot_date",
    )


def stage_transition(
    current: DataFrame, prior: DataFrame | None, *, count_days: bool = False
) -> DataFrame:
    """Add previous stage, entry date and days in stage from the prior snapshot.

    ``days_in_stage`` counts runs by default; ``count_days`` measures calendar
    days since the stage was entered.
    """
    day = F.col("snapshot_date")
    if prior is None:
        return current.withColumns({
            "previous_stage": F.lit(None).cast("string"),
            "stage_entered_at": day, "days_in_stage": F.lit(0),
        })
    before = prior.select(
        "hashed_member_id", F.col("stage").alias("previous_stage"),
        F.col("stage_entered_at").alias("__entered"), F.col("days_in_stage").alias("__days"),
    )
    same = F.col("previous_stage") == F.col("stage")
    entered = F.when(same, F.col("__entered")).otherwise(day)
    runs = F.when(same, F.coalesce("__days", F.lit(0)) + 1).otherwise(0)
    return (
        current.join(shuffled(before), "hashed_member_id", "left")
        .withColumns({
            "stage_entered_at": entered,
            "days_in_stage": F.datediff(day, entered) if count_days else runs,
        })
        .drop("__entered", "__days")
    )


def stage_distribution(lifecycle: DataFrame) -> DataFrame:
    """Members and share per stage in fixed order; the total is over seven rows."""
    everyone = W.partitionBy(F.lit(1))
    return (
        lifecycle.groupBy("stage").agg(F.count(F.lit(1)).alias("members"))
        .withColumn("pct", F.col("members") * 100.0 / F.sum("members").over(everyone))
        .withColumn("stage_order", rank_of(F.col("stage"), C.STAGE_ORDER))
        .orderBy("stage_order")
    )


def stage_transitions(lifecycle: DataFrame) -> DataFrame:
    return (
        lifecycle.filter(F.col("previous_stage").isNotNull()
                         & (F.col("previous_stage") != F.col("stage")))
        .groupBy("previous_stage", "stage").agg(F.count(F.lit(1)).alias("members"))
    )


def winback_opportunity(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.filter(F.col("stage") == "win_back_eligible").agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.sum("monthly_price"), F.lit(0.0)).alias("monthly_revenue"),
    )


def reengaged_count(lifecycle: DataFrame) -> DataFrame:
    back = F.col("previous_stage").isin("at_risk", "lapsed") & (F.col("stage") == "engaged")
    return lifecycle.agg(F.coalesce(count_when(back), F.lit(0)).alias("reengaged"))
