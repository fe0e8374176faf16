"""Per-member daily aggregates of the five activity feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, flag, has_text_intent

FEEDS = ["sessions", "transactions", "app_events", "ai_coach_chats", "email_events"]


def _day(ts: str) -> Column:
    return F.to_date(F.col(ts))


def as_of_date(tables: dict[str, DataFrame]) -> DataFrame:
    """Latest date over sessions, app events, transactions, emails and churn dates (one row)."""
    days = [
        tables["sessions"].select(_day("scheduled_at").alias("d")),
        tables["app_events"].select(_day("event_timestamp").alias("d")),
        tables["transactions"].select(F.col("transaction_date").alias("d")),
        tables["email_events"].select(_day("sent_at").alias("d")),
        tables["ground_truth"].select(F.col("churn_date").alias("d")),
    ]
    return reduce(DataFrame.unionByName, days).agg(F.max("d").alias("as_of_date"))


def as_of_column(tables: dict[str, DataFrame], as_of=None) -> Column:
    """A given date, or the data's own horizon, as a literal.

    The horizon is read once as a single value, so the plans built on it carry a
    constant that reaches the scans.
    """
    if as_of is None:
        as_of = as_of_date(tables).first()[0]
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def daily_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("member_id", _day("scheduled_at").alias("event_date")).agg(
        F.count(F.lit(1)).alias("booked_count"),
        count_when(F.col("attended")).alias("attended_count"),
        F.sum(F.when(F.col("attended"), F.col("sauna_temp_f")).otherwise(0.0)).alias("temp_sum"),
        count_when(F.col("attended")).alias("temp_count"),
    )


def _fee() -> Column:
    return F.col("transaction_type") == "Membership Fee"


def _retail_paid() -> Column:
    return F.col("transaction_type").startswith("Retail") & (F.col("status") == "Paid")


def daily_transactions(transactions: DataFrame) -> DataFrame:
    """The day's membership status is the lexical maximum, so Paid wins over Failed."""
    return transactions.groupBy("member_id", F.col("transaction_date").alias("event_date")).agg(
        F.sum(F.when(_retail_paid(), F.col("amount")).otherwise(0.0)).alias("retail_spend"),
        count_when(_fee() & (F.col("status") == "Failed")).alias("membership_failed_count"),
        F.max(F.when(_fee(), F.col("status"))).alias("membership_status"),
    )


def daily_app_events(app_events: DataFrame) -> DataFrame:
    return app_events.groupBy("member_id", _day("event_timestamp").alias("event_date")).agg(
        count_when(F.col("event_type") == "open_app").alias("logins_count"),
        count_when(F.col("event_type") == "view_metrics").alias("metric_views_count"),
    )


def _cancel_query(words: list[str]) -> Column:
    return (F.col("sender") == "member") & has_text_intent(F.col("message_text"), words)


def daily_chats(chats: DataFrame, words: list[str] = C.INTENT_WORDS) -> DataFrame:
    return chats.groupBy("member_id", _day("timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("chats_count"),
        count_when(_cancel_query(words)).alias("cancellation_queries_count"),
    )


def daily_emails(emails: DataFrame) -> DataFrame:
    return emails.groupBy("member_id", _day("sent_at").alias("event_date")).agg(
        F.count(F.lit(1)).alias("emails_sent"),
        count_when(F.col("status").isin("Opened", "Clicked")).alias("emails_opened"),
        count_when(F.col("status") == "Clicked").alias("emails_clicked"),
    )


COUNTS = [
    "booked", "attended", "failed", "logins", "views", "chats", "cancel_queries",
    "sent", "opened", "clicked",
]
AMOUNTS = ["temp_sum", "retail"]
_FEE_FLAGS = ["fee_failed", "fee_above", "fee_any"]


def daily_activity(tables: dict[str, DataFrame], words: list[str] = C.INTENT_WORDS) -> DataFrame:
    """All five feeds in one aggregation: one row per member and active day.

    Combining the feeds before grouping costs one shuffle (after map-side
    partial sums) instead of five shuffles and five joins. ``fee_state`` packs
    the day and whether its membership fee ended as Failed, so that a later
    maximum gives the latest state; ``attended_on`` is the day number.
    """
    status = F.col("status")
    feeds = [
        tables["sessions"].select(
            "member_id", _day("scheduled_at").alias("event_date"),
            F.lit(1).alias("booked"), flag(F.col("attended")).alias("attended"),
            F.when(F.col("attended"), F.col("sauna_temp_f")).alias("temp_sum"),
        ),
        tables["transactions"].select(
            "member_id", F.col("transaction_date").alias("event_date"),
            F.when(_retail_paid(), F.col("amount")).alias("retail"),
            flag(_fee() & (status == "Failed")).alias("failed"),
            flag(_fee() & (status == "Failed")).alias("fee_failed"),
            flag(_fee() & (status > "Failed")).alias("fee_above"),
            flag(_fee() & status.isNotNull()).alias("fee_any"),
        ),
        tables["app_events"].select(
            "member_id", _day("event_timestamp").alias("event_date"),
            flag(F.col("event_type") == "open_app").alias("logins"),
            flag(F.col("event_type") == "view_metrics").alias("views"),
        ),
        tables["ai_coach_chats"].select(
            "member_id", _day("timestamp").alias("event_date"),
            F.lit(1).alias("chats"), flag(_cancel_query(words)).alias("cancel_queries"),
        ),
        tables["email_events"].select(
            "member_id", _day("sent_at").alias("event_date"),
            F.lit(1).alias("sent"),
            flag(status.isin("Opened", "Clicked")).alias("opened"),
            flag(status == "Clicked").alias("clicked"),
        ),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    day_no = F.unix_date("event_date")
    grouped = rows.groupBy("member_id", "event_date").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in AMOUNTS],
        *[F.max(c).alias(c) for c in _FEE_FLAGS],
    )
    failed_day = (F.col("fee_failed") == 1) & (F.col("fee_above") == 0)
    return grouped.select(
        "member_id", "event_date", *COUNTS, *AMOUNTS,
        F.when(F.col("attended") > 0, day_no).alias("attended_on"),
        F.when(F.col("fee_any") == 1, day_no * 2 + flag(failed_day)).alias("fee_state"),
    )
