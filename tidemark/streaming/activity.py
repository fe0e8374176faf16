"""Streaming activity aggregates and flags.

Every function takes a DataFrame with an event-time column and works on a
stream or on a batch: watermarks bound the state of a stream and are ignored by
a batch, so both give the same rows on the same files.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, has_text_intent

# Groups that the members of a day are dealt to when late rows are counted.
LATE_PARTS = 64
# Rows of days and the windows they are part of that one task sums.
ROLLING_ROWS = 1_000_000
_NO_MEMBER = "\0"


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def activity_events(
    sessions: DataFrame | None = None, app_events: DataFrame | None = None,
    emails: DataFrame | None = None, transactions: DataFrame | None = None, chats: DataFrame | None = None,
    *, words: list[str] = C.INTENT_WORDS,
) -> DataFrame:
    """Feeds as one event table: member_id, ts, kind. Of chats, the member's own messages count."""
    parts = []
    if sessions is not None:
        kind = F.when(F.col("attended"), "attended").otherwise("booked")
        parts.append(sessions.select("member_id", F.col("scheduled_at").alias("ts"), kind.alias("kind")))
    if app_events is not None:
        parts.append(app_events.select("member_id", F.col("event_timestamp").alias("ts"),
                                       F.col("event_type").alias("kind")))
    if emails is not None:
        parts.append(emails.select("member_id", F.col("sent_at").alias("ts"), F.col("status").alias("kind")))
    if transactions is not None:
        kind = F.when(F.col("status") == "Failed", "failed_payment").otherwise("payment")
        parts.append(transactions.select("member_id", F.col("transaction_date").cast("timestamp_ntz").alias("ts"), kind.alias("kind")))
    if chats is not None:
        kind = F.when(has_text_intent(F.col("message_text"), words), "cancel_question").otherwise("chat")
        parts.append(chats.filter(F.col("sender") == "member").select(
            "member_id", F.col("timestamp").alias("ts"), kind.alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts() -> list[Column]:
    k = F.col("kind")
    return [
        F.count(F.lit(1)).alias("events"),
        count_when(k.isin("booked", "attended")).alias("booked"),
        count_when(k == "attended").alias("attended"),
        count_when(k == "open_app").alias("logins"),
        count_when(k == "view_metrics").alias("metric_views"),
        count_when(k.isin("Sent", "Delivered", "Bounced", "Opened", "Clicked")).alias("emails_sent"),
        count_when(k.isin("Opened", "Clicked")).alias("emails_opened"),
        count_when(k == "Clicked").alias("emails_clicked"),
        count_when(k.isin("payment", "failed_payment")).alias("payments"),
        count_when(k == "failed_payment").alias("failed_payments"),
        count_when(k.isin("chat", "cancel_question")).alias("chats"),
        count_when(k == "cancel_question").alias("cancel_questions"),
    ]


MEASURES = [
    "events", "booked", "attended", "logins", "metric_views", "emails_sent", "emails_opened", "emails_clicked",
    "payments", "failed_payments", "chats", "cancel_questions",
]


def _daily(events: DataFrame, delay: str) -> DataFrame:
    return _timed(events, "ts", delay).groupBy("member_id", F.window("ts", "1 day").alias("w")).agg(*_counts())


def stream_daily_activity(events: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Per member and day; a day is final once the watermark passes its end."""
    return _daily(events, delay).select("member_id", F.to_date("w.start").alias("event_date"), *MEASURES)


def stream_rolling_activity(events: DataFrame, *, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Sums over the trailing days, one row per member and closing day.

    Events are counted by day first, so only daily rows are copied into the sliding windows.
    """
    return (
        _daily(events, delay).withColumn("ts", F.window_time("w")).drop("w")
        .groupBy("member_id", F.window("ts", f"{days} days", "1 day").alias("v"))
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
        .select("member_id", F.date_sub(F.to_date("v.end"), 1).alias("date_day"), *MEASURES)
    )


def rolling_activity(events: DataFrame, *, days: int = 30, rows_per_task: int = ROLLING_ROWS) -> DataFrame:
    """The rows of ``stream_rolling_activity`` over a whole history, with one shuffle by member.

    Each active day counts on ``days`` days, so tasks follow the rows after that, not the shuffled events.
    """
    n = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() * days // rows_per_task))
    day = F.to_date("ts").alias("event_date")
    daily = events.filter(F.col("ts").isNotNull()).repartition(n, "member_id").groupBy("member_id", day).agg(*_counts())
    closing = F.explode(F.sequence("event_date", F.date_add("event_date", days - 1)))
    return daily.withColumn("date_day", closing).groupBy("member_id", "date_day").agg(*[F.sum(m).alias(m) for m in MEASURES])


def stream_send_rate_guard(
    audit: DataFrame, *, limit: int = 50, span: str = "60 minutes", slide: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Rolling hours with more live sends than allowed."""
    sent = audit.filter(F.col("status") == "Sent").select("sent_at")
    return (
        _timed(sent, "sent_at", delay).groupBy(F.window("sent_at", span, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("sends"))
        .filter(F.col("sends") > limit)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sends")
    )


def stream_intent_flags(
    transactions: DataFrame, chats: DataFrame, *, words: list[str] = C.INTENT_WORDS,
    delay: str = "1 hour",
) -> DataFrame:
    """Failed payments and cancel questions as flags; a redelivered event is flagged once."""
    failed = transactions.filter(F.col("status") == "Failed").select(
        F.col("transaction_id").alias("event_id"), "member_id",
        F.col("transaction_date").cast("timestamp").alias("ts"), F.lit("payment_failed").alias("flag"))
    asked = chats.filter((F.col("sender") == "member") & has_text_intent(F.col("message_text"), words)).select(
        F.col("chat_id").alias("event_id"), "member_id",
        F.col("timestamp").cast("timestamp").alias("ts"), F.lit("cancel_question").alias("flag"))
    both = failed.unionByName(asked)
    if both.isStreaming:
        return both.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id", "flag"])
    return both.dropDuplicates(["event_id", "flag"])


def stream_member_sessions(events: DataFrame, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of a member's activity separated by a quiet gap; an event after exactly the gap begins a new one.

    Spark joins a session to one that begins at its very end, so its gap is a microsecond short.
    """
    end = F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")
    return (
        _timed(events, "ts", delay).groupBy("member_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("member_id", F.col("w.start").alias("session_start"), end.alias("session_end"), "events")
    )


def stream_late_rows(events: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """(member_id, event_date, rows) of events that come after their day is final, for each run that meets some.

    These are the rows that ``stream_daily_activity`` with the same delay passes over. No state is kept;
    a batch has no late rows. Whether rows are late depends on their day alone, so members of a day go through Python
    in ``LATE_PARTS`` groups, not one by one.
    """
    def late(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        final = pd.Timestamp(key[0] + timedelta(days=1)).value // 1_000_000 <= state.getCurrentWatermarkMs()
        rows: Counter = Counter()
        for part in parts:
            if final:
                rows.update(part["member_id"].fillna(_NO_MEMBER).value_counts(sort=False).to_dict())
        if rows:
            yield pd.DataFrame({"member_id": [None if m == _NO_MEMBER else m for m in rows], "event_date": key[0], "rows": list(rows.values())})

    days = _timed(events, "ts", delay).withColumn("event_date", F.to_date("ts")).withColumn(
        "part", F.pmod(F.xxhash64("member_id"), F.lit(LATE_PARTS)))
    return days.select("member_id", "ts", "event_date", "part").groupBy("event_date", "part").applyInPandasWithState(
        late, "member_id string, event_date date, rows long", "seen long", "append", GroupStateTimeout.NoTimeout)
