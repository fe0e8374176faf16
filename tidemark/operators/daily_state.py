"""The daily run: a member state that one day's feeds move on, and the panel rows that follow from it.

The state of a day holds, for each member with any activity since joining, the last visit, the last membership
fee and a ring of the daily sums of the last ``long_days`` days (active days only). It is all that the next
day's panel rows need of the past, so a daily run reads yesterday's state and the new day of each feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.activity import AMOUNTS, COUNTS, daily_activity
from tidemark.operators.features import SHORT, _finish, _member_frame

LONG_DAYS, SHORT_DAYS = 30, 7
RING = "array<struct<day:int," + ",".join([*(f"{c}:bigint" for c in COUNTS), *(f"{c}:double" for c in AMOUNTS), "attended_on:int", "fee_state:int"]) + ">>"
STATE = f"member_id string, ring {RING}, last_attended int, last_fee int, state_day date"


def _by_member(acts: DataFrame, recent: Column) -> DataFrame:
    """Daily activity as one row per member: the recent days as a ring, and the last visit and fee of all days."""
    entry = F.struct(
        F.unix_date("event_date").alias("day"), *(F.col(c).cast("bigint").alias(c) for c in COUNTS),
        *(F.col(c).cast("double").alias(c) for c in AMOUNTS), *(F.col(c).cast("int").alias(c) for c in ("attended_on", "fee_state")))
    return acts.groupBy("member_id").agg(
        F.array_sort(F.collect_list(F.when(recent, entry))).alias("ring"),
        F.max("attended_on").cast("int").alias("last_attended"), F.max("fee_state").cast("int").alias("last_fee"))


def since_joining(tables: dict[str, DataFrame]) -> DataFrame:
    """Daily activity of the days in the feeds; days before joining do not count."""
    return daily_activity(tables).join(tables["members"].select("member_id", "join_date"), "member_id").filter(
        F.col("event_date") >= F.col("join_date"))


def member_activity(tables: dict[str, DataFrame]) -> DataFrame:
    """(member_id, ring, last_attended, last_fee) of the days in the feeds, one row per member.

    For feeds of a few days: all their days are in the ring. Days before joining do not count.
    """
    return _by_member(since_joining(tables), F.lit(True))


def initial_state(tables: dict[str, DataFrame], day, *, long_days: int = LONG_DAYS) -> DataFrame:
    """The state of ``day`` from all history, for the first run or a rebuild.

    Only the ring's days are gathered per member; older ones are folded to the last visit and fee.
    """
    day = F.lit(day).cast("date")
    acts = since_joining(tables).filter(F.col("event_date") <= day)
    return _by_member(acts, F.col("event_date") > F.date_sub(day, long_days)).withColumn("state_day", day)


def moved_on(state: DataFrame, activity: DataFrame, day, *, long_days: int = LONG_DAYS) -> DataFrame:
    """The state of ``day`` from an earlier state and the activity of the days since (``member_activity``).

    A day must not be in both; running a day again starts from the state before it, so it gives the same rows.
    """
    new = activity.select("member_id", *(F.col(c).alias(f"new_{c}") for c in ("ring", "last_attended", "last_fee")))
    none = F.array().cast(RING)
    oldest = F.unix_date(F.lit(day).cast("date")) - long_days
    ring = F.concat(F.coalesce("ring", none), F.coalesce("new_ring", none))
    return state.drop("state_day").join(new, "member_id", "full_outer").select(
        "member_id", F.filter(ring, lambda e: e["day"] > oldest).alias("ring"),
        F.greatest("last_attended", "new_last_attended").alias("last_attended"),
        F.greatest("last_fee", "new_last_fee").alias("last_fee"), F.lit(day).cast("date").alias("state_day"))


def panel_rows(state: DataFrame, activity: DataFrame | None, tables: dict[str, DataFrame], *, salt: str, first, last,
               long_days: int = LONG_DAYS, short_days: int = SHORT_DAYS, label_days: int = 14) -> DataFrame:
    """The panel's rows of the days from ``first`` to ``last``, from the state before them and their activity.

    ``activity`` is ``since_joining`` of those days' feeds; without it the state itself is that of the one day
    asked for. Each day of a ring counts on the days it is still part of; no window and no order is needed.
    The rows are those of ``features.member_features_daily``.
    """
    first, last = F.lit(first).cast("date"), F.lit(last).cast("date")
    begin, end = F.unix_date(first), F.unix_date(last)
    # What is older than the ring comes as one entry without a day.
    older = F.struct(F.lit(None).cast("int").alias("day"), *(F.lit(0).cast("bigint").alias(c) for c in COUNTS),
                     *(F.lit(0.0).alias(c) for c in AMOUNTS), F.col("last_attended").alias("attended_on"), F.col("last_fee").alias("fee_state"))
    entries = state.select("member_id", F.inline(F.concat(F.array(older), F.coalesce("ring", F.array().cast(RING)))))
    if activity is not None:
        entries = entries.unionByName(activity.select(
            "member_id", F.unix_date("event_date").alias("day"), *COUNTS, *AMOUNTS, *(F.col(c).cast("int").alias(c) for c in ("attended_on", "fee_state"))))
    counted = entries.withColumn("number", F.explode(F.sequence(F.greatest(begin, F.coalesce("day", begin)), end)))
    age = F.col("number") - F.col("day")
    sums = counted.groupBy("member_id", F.date_from_unix_date("number").alias("date_day")).agg(
        *(F.sum(F.when(age < long_days, F.col(c)).otherwise(0)).alias(f"{c}_30d") for c in COUNTS),
        *(F.sum(F.when(age < long_days, F.col(c)).otherwise(0.0)).alias(f"{c}_30d") for c in AMOUNTS),
        *(F.sum(F.when(age < short_days, F.col(c)).otherwise(0)).alias(f"{c}_7d") for c in SHORT),
        F.max("attended_on").alias("last_attended"), F.max("fee_state").alias("last_fee"))
    people = _member_frame(tables, salt)
    own = F.greatest("join_date", first), F.least(F.coalesce("churn_date", last), last)
    days = people.filter(own[0] <= own[1]).withColumn("date_day", F.explode(F.sequence(*own)))
    zero = {**{f"{c}_30d": 0 for c in COUNTS}, **{f"{c}_7d": 0 for c in SHORT}, **{f"{c}_30d": 0.0 for c in AMOUNTS}}
    return _finish(days.join(sums, ["member_id", "date_day"], "left").fillna(zero), label_days)
