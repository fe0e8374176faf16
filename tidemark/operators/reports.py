"""Experiment readouts, studio health and the daily digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, percent_text, ratio
from tidemark.operators.scoring import scored_features

TREATED = ["Sent", "DryRun", "Pending"]


def _arms(queue: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """One row per member and arm with the churn flag."""
    arm = F.when(F.col("status") == "Holdout", "holdout").when(
        F.col("status").isin(TREATED), "treatment")
    return (
        queue.select("member_id", arm.alias("arm")).filter(F.col("arm").isNotNull()).distinct()
        .join(ground_truth.select("member_id", "churned"), "member_id")
    )


def _arm_counts(queue: DataFrame, ground_truth: DataFrame) -> DataFrame:
    h, t = F.col("arm") == "holdout", F.col("arm") == "treatment"
    zero = F.lit(0)
    return _arms(queue, ground_truth).agg(
        F.coalesce(count_when(h), zero).alias("n_holdout"),
        F.coalesce(count_when(t), zero).alias("n_treatment"),
        F.coalesce(count_when(h & F.col("churned")), zero).alias("churned_holdout"),
        F.coalesce(count_when(t & F.col("churned")), zero).alias("churned_treatment"),
    )


def ab_lift(queue: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Churn rates of both arms and the lift; an empty arm gives nulls (one row)."""
    c = F.col
    out = _arm_counts(queue, ground_truth).withColumns({
        "rate_holdout": ratio(c("churned_holdout"), c("n_holdout")),
        "rate_treatment": ratio(c("churned_treatment"), c("n_treatment")),
    })
    lift = c("rate_holdout") - c("rate_treatment")
    return out.withColumn("lift", lift).withColumn(
        "relative_lift", F.when(c("rate_holdout") > 0, c("lift") / c("rate_holdout")))


def ab_significance(queue: DataFrame, ground_truth: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Pearson chi-square on the 2x2 table of arm and churn (one degree of freedom).

    The p-value is erfc(sqrt(x / 2)), evaluated by a rational approximation with
    absolute error below 1.2e-7.
    """
    a, b = F.col("churned_holdout"), F.col("n_holdout") - F.col("churned_holdout")
    c, d = F.col("churned_treatment"), F.col("n_treatment") - F.col("churned_treatment")
    n = a + b + c + d
    den = (a + b) * (c + d) * (a + c) * (b + d)
    cross = (a * d - b * c).cast("double")
    chi = F.when(den > 0, n * cross * cross / den.cast("double"))
    return _arm_counts(queue, ground_truth).withColumn("chi_square", chi).withColumn(
        "p_value", erfc(F.sqrt(F.col("chi_square") / 2))
    ).withColumn("significant", F.col("p_value") < alpha)


# Coefficients of the Chebyshev-fitted complementary error function.
_ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (1.0 + x / 2.0)
    poly = F.lit(0.0)
    for coefficient in reversed(_ERFC):
        poly = poly * t + coefficient
    return t * F.exp(-x * x + poly)


def ab_saved_revenue(queue: DataFrame, ground_truth: DataFrame, memberships: DataFrame) -> DataFrame:
    """Treated members times absolute lift times their average monthly price (one row)."""
    treated = (
        _arms(queue, ground_truth).filter(F.col("arm") == "treatment").select("member_id")
        .join(memberships.select("member_id", "monthly_price"), "member_id")
    )
    price = treated.agg(F.avg("monthly_price")).scalar()
    return (
        ab_lift(queue, ground_truth).select("n_treatment", "lift")
        .withColumn("avg_monthly_price", price)
        .withColumn("saved_revenue", F.col("n_treatment") * F.col("lift") * F.col("avg_monthly_price"))
    )


def ab_assignment_stability(queue: DataFrame) -> DataFrame:
    """Members seen in both arms; should be empty."""
    arm = F.when(F.col("status") == "Holdout", 1).when(F.col("status").isin(TREATED), 2)
    return (
        queue.groupBy("member_id").agg(F.min(arm).alias("lo"), F.max(arm).alias("hi"))
        .filter(F.col("lo") != F.col("hi")).select("member_id")
    )


def studio_health(scores: DataFrame, features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """0-100 per studio from its retention and the programme's outcome success."""
    good = outcomes.agg(
        F.coalesce(F.avg(F.col("outcome_30d").isin(C.POSITIVE_OUTCOMES).cast("double")) * 100, F.lit(0.0))
    ).scalar()
    total = F.countDistinct("hashed_member_id")
    safe = total - count_when(F.col("risk_tier").isin(C.AT_RISK_TIERS))
    keep = F.col("retention_rate")
    raw = (keep * 0.5 + F.col("outcome_success") * 0.3
           + F.least(F.lit(100.0), keep * 1.1) * 0.2)
    return (
        scored_features(scores, features).groupBy("home_studio_id").agg(
            total.alias("active_members"), (safe / total * 100).alias("retention_rate"))
        .withColumn("outcome_success", good)
        .withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(raw, 9)))).cast("int"))
    )


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First k rows per group. The rank limit also runs before the shuffle, so each task
    sends at most k rows of a group."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def studio_tasks(
    scores: DataFrame, features: DataFrame, lifecycle: DataFrame, identity: DataFrame, *,
    calls: int = 6, winbacks: int = 4, welcomes: int = 3,
) -> DataFrame:
    """Named follow-ups of every studio: calls, win-backs, welcomes, in that order.

    Names are joined after the per-studio limits.
    """
    risky = scored_features(scores.filter(F.col("risk_tier").isin("Critical", "High")), features)
    hid = F.asc("hashed_member_id")
    lc = lifecycle.select("hashed_member_id", "home_studio_id", "stage", "monthly_price")
    picked = (
        top_k_per_group(risky, "home_studio_id", [F.desc("churn_probability"), hid], calls)
        .select("home_studio_id", "hashed_member_id", "position", F.lit(1).alias("kind"),
                F.lit("Call ").alias("lead"),
                F.concat(F.lit(" — "), "risk_tier", F.lit(" risk ("),
                         percent_text(F.col("churn_probability")), F.lit(")")).alias("tail"))
        .unionByName(
            top_k_per_group(lc.filter(F.col("stage") == "win_back_eligible"), "home_studio_id",
                            [F.desc("monthly_price"), hid], winbacks)
            .select("home_studio_id", "hashed_member_id", "position", F.lit(2).alias("kind"),
                    F.lit("Win-back outreach: ").alias("lead"),
                    F.concat(F.lit(" ($"), F.bround("monthly_price", 0).cast("long").cast("string"),
                             F.lit("/mo)")).alias("tail")))
        .unionByName(
            top_k_per_group(lc.filter(F.col("stage") == "onboarding"), "home_studio_id", [hid], welcomes)
            .select("home_studio_id", "hashed_member_id", "position", F.lit(3).alias("kind"),
                    F.lit("Welcome check-in: ").alias("lead"), F.lit("").alias("tail")))
    )
    return picked.join(identity.select("hashed_member_id", "name"), "hashed_member_id", "left").select(
        "home_studio_id", "kind", "position", "hashed_member_id",
        F.concat("lead", F.coalesce("name", F.lit("Unknown")), "tail").alias("task"),
    )


def studio_digest(
    scores: DataFrame, features: DataFrame, lifecycle: DataFrame, identity: DataFrame,
    outcomes: DataFrame, board: DataFrame | None = None, *, idle_days: int = 14, title: str = "DAILY DIGEST",
) -> DataFrame:
    """All studios' digests in one job: counts, tasks, stage counts, effectiveness, rank, text.

    Effectiveness covers the whole organisation. Each studio's task list is at
    most 13 lines long.
    """
    counts = scored_features(scores, features).groupBy("home_studio_id").agg(
        count_when(F.col("risk_tier") == "Critical").alias("critical_calls"),
        count_when(F.col("last_recurring_payment_failed")).alias("payment_failures"),
        count_when(F.col("days_since_last_session") > idle_days).alias("inactive_members"),
    )
    stage = F.col("stage")
    stages = lifecycle.filter(F.col("home_studio_id").isNotNull()).groupBy("home_studio_id").agg(
        count_when(stage == "at_risk").alias("at_risk"),
        count_when(stage == "win_back_eligible").alias("winback_eligible"),
        count_when(stage == "onboarding").alias("onboarding"),
        F.sum(F.when(stage == "win_back_eligible", F.col("monthly_price")).otherwise(0.0)).alias("winback_revenue"),
    )
    tasks = studio_tasks(scores, features, lifecycle, identity).groupBy("home_studio_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "position", "task"))).alias("__t")
    ).select("home_studio_id", F.array_join(F.col("__t.task"), "\n").alias("tasks"))
    effect = outcomes.agg(F.struct(
        F.coalesce(count_when(F.col("outcome_30d").isin(C.POSITIVE_OUTCOMES)), F.lit(0)).alias("positive"),
        F.count(F.lit(1)).alias("total"),
    )).scalar()
    out = stages.join(counts, "home_studio_id", "full_outer").join(tasks, "home_studio_id", "left")
    if board is not None:
        out = out.join(board.select(
            "home_studio_id", F.col("rank").alias("winback_rank"), "reactivation_rate", "bonus_award",
            F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("__of")),  # one row per studio
            "home_studio_id", "left")
    ints = ["critical_calls", "payment_failures", "inactive_members", "at_risk", "winback_eligible", "onboarding"]
    out = out.fillna(0, ints).fillna(0.0, ["winback_revenue"]).withColumn("__e", effect)
    c = F.col
    tasks_text = F.coalesce("tasks", F.lit("All clear — no high-priority follow-ups."))
    rank_line = F.lit(None).cast("string") if board is None else F.when(c("winback_rank").isNotNull(), F.format_string(
        "Win-back rank: #%d of %d (%d%% reactivation, $%s bonus pace)", c("winback_rank"), c("__of"),
        F.bround(c("reactivation_rate") * 100, 0).cast("long"), F.format_number(F.bround("bonus_award", 0), 0)))
    lines = [
        F.concat(F.lit(title + " — "), c("home_studio_id")),
        rank_line,
        F.format_string("%d critical calls needed", "critical_calls"),
        F.format_string("%d payment failures to resolve", "payment_failures"),
        F.format_string(f"%d members inactive {idle_days}+ days", "inactive_members"),
        F.concat(F.lit("YOUR TASKS TODAY:\n"), tasks_text),
        F.format_string("At-risk: %d | Win-back eligible: %d | Onboarding: %d",
                        "at_risk", "winback_eligible", "onboarding"),
        F.when(c("winback_eligible") > 0, F.concat(
            F.lit("Win-back revenue opportunity: $"), F.bround("winback_revenue", 0).cast("long").cast("string"),
            F.lit("/mo"))),
        F.when(c("__e.total") > 0, F.format_string(
            "%d/%d interventions had positive outcomes (%d%%)", c("__e.positive"), c("__e.total"),
            F.bround(c("__e.positive") * 100 / c("__e.total"), 0).cast("long"))),
    ]
    return out.withColumns({
        "positive_outcomes": c("__e.positive"), "total_outcomes": c("__e.total"),
        "digest": F.concat_ws("\n", *lines),
    }).drop("__e", "__of")
