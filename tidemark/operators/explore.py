"""Exploration reports over the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def monthly_signups(members: DataFrame) -> DataFrame:
    return members.groupBy(F.date_format("join_date", "yyyy-MM").alias("join_month")).agg(
        F.count(F.lit(1)).alias("signups")).orderBy("join_month")


def booking_heatmap(sessions: DataFrame, ts: str = "scheduled_at") -> DataFrame:
    """Bookings by weekday (Monday first) and hour, zero filled.

    The hours are listed, so the pivot needs no extra pass to find them.
    """
    dow = F.weekday(ts)
    wide = (
        sessions.select(dow.alias("day_no"), F.hour(ts).alias("hour"))
        .groupBy("day_no").pivot("hour", list(range(24))).count()
    )
    spark = sessions.sparkSession
    week = spark.createDataFrame(list(enumerate(DAYS)), "day_no int, day_of_week string")
    hours = {str(h): F.coalesce(F.col(f"`{h}`"), F.lit(0)).cast("long") for h in range(24)}
    return week.join(wide, "day_no", "left").select(
        "day_no", "day_of_week", *[v.alias(f"h{int(k):02d}") for k, v in hours.items()]
    ).orderBy("day_no")


def active_at_month(
    members: DataFrame, ground_truth: DataFrame, *, first: Column, last: Column
) -> DataFrame:
    """Active members at each month end per cohort.

    ``first`` and ``last`` are days in the months to report. Active means joined by then and not churned by then. Counting joins and
    departures per month and summing forward replaces a join of every member
    with every month; the running sum works on cohorts times months.
    """
    spark = members.sparkSession
    churned = F.coalesce("churned", F.lit(False))
    people = (
        members.select("member_id", "join_date")
        .join(ground_truth.select("member_id", "cohort", "churned", "churn_date"), "member_id")
        .filter(~churned | F.col("churn_date").isNotNull())
    )

    def month_end(d: Column) -> Column:
        return F.last_day(d)

    left = F.when(churned, F.greatest("join_date", "churn_date"))
    moves = people.select(
        "cohort",
        F.explode(F.array(
            F.struct(month_end(F.col("join_date")).alias("month"), F.lit(1).alias("n")),
            F.struct(month_end(left).alias("month"), F.lit(-1).alias("n")),
        )).alias("m"),
    ).select("cohort", "m.month", "m.n").filter(F.col("month").isNotNull())
    net = moves.groupBy("cohort", "month").agg(F.sum("n").alias("n"))
    axis = people.select("cohort").distinct().select(
        "cohort",
        F.explode(F.sequence(F.last_day(first), F.last_day(last),
                             F.expr("interval 1 month"))).alias("__m"),
    ).select("cohort", F.last_day("__m").alias("month"), F.lit(0).cast("long").alias("n"))
    running = W.partitionBy("cohort").orderBy("month").rangeBetween(W.unboundedPreceding, 0)
    return (
        net.unionByName(axis).groupBy("cohort", "month").agg(F.sum("n").alias("n"))
        .withColumn("active_members", F.sum("n").over(running))
        .join(axis.select("cohort", "month"), ["cohort", "month"], "left_semi")
        .drop("n")
    )


def fail_to_cancel_lag(
    ground_truth: DataFrame, transactions: DataFrame, *, cohort: str = "sudden_drop"
) -> DataFrame:
    """Days from each failed fee of a churned cohort member to the churn date (one row of statistics)."""
    gone = ground_truth.filter(F.col("churned") & (F.col("cohort") == cohort)).select(
        "member_id", "churn_date")
    failed = transactions.filter(
        (F.col("transaction_type") == "Membership Fee") & (F.col("status") == "Failed")
    ).select("member_id", "transaction_date")
    days = F.datediff("churn_date", "transaction_date")
    return failed.join(gone, "member_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg(days), 6).alias("mean_days"),
        F.round(F.stddev_samp(days), 6).alias("std_days"),
    )


def attendance_by_lifetime_decile(
    members: DataFrame, ground_truth: DataFrame, sessions: DataFrame, *, cohort: str = "declining"
) -> DataFrame:
    """Attendance rate of churned cohort members by share of their lifetime elapsed."""
    people = (
        ground_truth.filter(F.col("churned") & (F.col("cohort") == cohort)).select("member_id", "churn_date")
        .join(members.select("member_id", "join_date"), "member_id")
    )
    life = F.datediff("churn_date", "join_date")
    at = F.datediff(F.to_date("scheduled_at"), F.col("join_date"))
    progress = (
        F.when(life != 0, at / life)
        .when(at > 0, 1.0).when(at < 0, 0.0)
    )
    b = F.least(F.greatest(F.bround(progress * 10, 0) / 10, F.lit(0.0)), F.lit(1.0))
    return (
        sessions.select("member_id", "scheduled_at", "attended").join(people, "member_id")
        .withColumn("progress_bin", b).filter(F.col("progress_bin").isNotNull())
        .groupBy("progress_bin").agg(
            F.count(F.lit(1)).alias("sessions"),
            F.round(F.avg(F.col("attended").cast("double")), 6).alias("attendance_rate"))
        .orderBy("progress_bin")
    )
