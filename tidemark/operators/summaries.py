"""Member briefs: the metric payload, the rule-based text and checks on generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import nan_to_null
from tidemark.operators.scoring import last_n_per_key, latest_by_key

PAYLOAD_FIELDS = [
    "as_of_date", "member_ref", "membership_tier", "monthly_price", "tenure_days",
    "churn_risk_tier", "churn_probability", "lifecycle_stage", "days_in_stage",
    "days_since_last_session", "sessions_attended_30d", "sessions_booked_30d",
    "attendance_rate_30d", "app_logins_30d", "coach_chats_30d", "retail_spend_30d",
    "email_open_rate_30d", "recent_payment_failed", "failed_payments_30d",
    "has_cancellation_query_30d", "recent_chat_messages",
]


def recent_chats(
    chats: DataFrame, as_of: Column, *, lookback_days: int = 45, n: int = 8
) -> DataFrame:
    """Last n messages per member inside the lookback, oldest first, as one array.

    The rank limit runs before the shuffle, so arrays never exceed n entries and
    a member with very many messages costs n rows per task.
    """
    recent = chats.filter(F.to_date("timestamp") >= F.date_sub(as_of, lookback_days))
    last = last_n_per_key(recent, ["member_id"], ["timestamp", "chat_id"], n)
    entry = F.struct(
        F.col("timestamp").alias("timestamp"), F.col("chat_id").alias("id"),
        F.col("sender").alias("sender"), F.col("message_text").alias("text"),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return last.groupBy("member_id").agg(F.array_sort(F.collect_list(entry)).alias("m")).select(
        "member_id",
        F.transform("m", lambda e: F.struct(
            F.date_format(e["timestamp"], iso).alias("timestamp"),
            e["sender"].alias("sender"), e["text"].alias("text"),
        )).alias("recent_chat_messages"),
    )


def member_payload(
    features: DataFrame, scores: DataFrame, lifecycle: DataFrame, identity: DataFrame,
    chats: DataFrame, *, as_of: Column, lookback_days: int = 45, n_chats: int = 8,
) -> DataFrame:
    """Payload columns of every member in the snapshot of ``as_of``; no name, email or phone."""
    score = latest_by_key(scores, ["hashed_member_id"], "score_date").select(
        "hashed_member_id", F.col("churn_probability").alias("__p"), F.col("risk_tier").alias("churn_risk_tier"))
    life = latest_by_key(lifecycle, ["hashed_member_id"], "snapshot_date").select(
        "hashed_member_id", F.col("stage").alias("lifecycle_stage"), "days_in_stage")
    rows = (
        features.filter(F.col("date_day") == as_of)
        .join(score, "hashed_member_id", "left")
        .join(life, "hashed_member_id", "left")
        .join(identity.select("hashed_member_id", "member_id"), "hashed_member_id", "left")
        .join(recent_chats(chats, as_of, lookback_days=lookback_days, n=n_chats), "member_id", "left")
    )
    empty = F.array().cast("array<struct<timestamp:string,sender:string,text:string>>")
    c = F.col
    return rows.select(
        "hashed_member_id",
        F.date_format("date_day", "yyyy-MM-dd").alias("as_of_date"),
        F.coalesce("member_id", F.left("hashed_member_id", F.lit(10))).alias("member_ref"),
        "membership_tier", nan_to_null(c("monthly_price"), "double").alias("monthly_price"), "tenure_days",
        "churn_risk_tier", F.round(nan_to_null(c("__p"), "double"), 3).alias("churn_probability"),
        "lifecycle_stage", "days_in_stage", "days_since_last_session", "sessions_attended_30d",
        "sessions_booked_30d", nan_to_null(c("attendance_rate_30d"), "double").alias("attendance_rate_30d"),
        "app_logins_30d", c("coach_chat_count_30d").alias("coach_chats_30d"),
        nan_to_null(c("retail_spend_30d"), "double").alias("retail_spend_30d"),
        nan_to_null(c("email_open_rate_30d"), "double").alias("email_open_rate_30d"),
        c("last_recurring_payment_failed").alias("recent_payment_failed"),
        c("failed_payments_count_30d").alias("failed_payments_30d"),
        "has_cancellation_query_30d",
        F.coalesce("recent_chat_messages", empty).alias("recent_chat_messages"),
    )


def payload_json(payload: DataFrame) -> DataFrame:
    """Payload rows with a ``payload`` JSON column; absent values are written as null."""
    body = F.to_json(F.struct(*PAYLOAD_FIELDS), {"ignoreNullFields": "false"})
    return payload.withColumn("payload", body)


def rules_summary(payload: DataFrame) -> DataFrame:
    """Deterministic brief per member: summary, at most 4 steps and 3 talking points."""
    idle = F.col("days_since_last_session")
    paid = F.coalesce("recent_payment_failed", F.lit(False))
    asked = F.coalesce("has_cancellation_query_30d", F.lit(False))
    away = F.coalesce(idle > 14, F.lit(False))

    def pick(*pairs: tuple[Column, Column | str]) -> Column:
        return F.array_compact(F.array(*[
            F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs
        ]))

    # Sentences of the rule-based brief.
    head = F.concat(
        F.coalesce("membership_tier", F.lit("Member")), F.lit(" member, "),
        F.coalesce("churn_risk_tier", F.lit("Unknown")), F.lit(" churn risk."))
    bits = pick(
        (F.lit(True), head),
        (paid, "Most recent membership payment failed."),
        (asked, "Asked about freezing/cancelling in coach chat recently."),
        (away, F.concat(F.lit("No attended session in "), idle.cast("string"), F.lit(" days."))),
    )
    steps = pick(
        (paid, "Resolve the failed payment — offer to update the card on file."),
        (asked, "Address the cancellation/freeze question directly and empathetically."),
        (away, "Invite them to a specific class time this week."),
    )
    points = pick(
        (paid, "Lead with helping fix the billing hiccup, not selling."),
        (away, "Ask if anything changed with their schedule or goals."),
    )
    no_steps = F.array(F.lit("Check in, thank them for their engagement, and ask about goals."))
    no_points = F.array(F.lit("Keep it friendly and personal."))
    return payload.withColumns({
        "summary": F.array_join(bits, " "),
        "next_steps": F.slice(F.when(F.size(steps) > 0, steps).otherwise(no_steps), 1, 4),
        "talking_points": F.slice(F.when(F.size(points) > 0, points).otherwise(no_points), 1, 3),
        "source": F.lit("rules"),
    })


def _digit_runs(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d{%d,})" % least), F.lit(1))


RATE_FIELDS = ["churn_probability", "attendance_rate_30d", "email_open_rate_30d"]


def validate_summary_numbers(
    df: DataFrame, *, text: str = "text", payload: str = "payload", rates: list[str] = RATE_FIELDS
) -> DataFrame:
    """Adds ``numbers_ok``: every run of two or more digits in the text occurs in the payload.

    Percent forms of rate values strictly between 0 and 1 count as present.
    """
    forms = []
    for r in rates:
        pct = F.col(r) * 100
        inside = (F.col(r) > 0) & (F.col(r) < 1)
        forms.append(F.when(inside, F.concat_ws(
            " ", F.format_string("%.1f", pct), F.format_string("%.0f", pct),
            F.bround(pct, 0).cast("long").cast("string"))))
    allowed = F.array_union(_digit_runs(F.col(payload)), _digit_runs(F.concat_ws(" ", *forms)))
    invented = F.array_except(_digit_runs(F.col(text), 2), allowed)
    return df.withColumns({"invented": invented, "numbers_ok": F.size(invented) == 0})


SUMMARY_DDL = "summary string, next_steps array<string>, talking_points array<string>"


def parse_summary_json(raw: Column) -> Column:
    """The JSON object in a reply: the whole text first, else from first to last brace.

    Null when neither parses or when summary or next_steps is missing.
    """
    def parsed(text: Column) -> Column:
        got = F.from_json(text, SUMMARY_DDL)
        return F.when(got["summary"].isNotNull() & got["next_steps"].isNotNull(), got)

    span = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(parsed(F.when(F.trim(raw).startswith("{"), raw)), parsed(span))


def finalize_summaries(df: DataFrame, *, reply: str = "reply", model_name: str = "generated") -> DataFrame:
    """Accept generated replies that parse and invent no numbers; otherwise use the rules.

    ``df`` has the payload columns, ``payload`` and the reply text (null when no
    reply arrived). Adds source and fallback reason.
    """
    rules = rules_summary(df).withColumn("__g", parse_summary_json(F.col(reply)))
    g = F.col("__g")
    words = F.concat_ws(" ", g["summary"], F.array_join(g["next_steps"], " "),
                        F.array_join(F.coalesce(g["talking_points"], F.array().cast("array<string>")), " "))
    checked = validate_summary_numbers(rules.withColumn("__words", words), text="__words")
    # Fallback reasons.
    reason = (
        F.when(F.col(reply).isNull(), "LLM unavailable")
        .when(g.isNull(), "LLM returned unparseable output")
        .when(~F.col("numbers_ok"), "LLM output contained numbers not present in source data")
    )
    ok = reason.isNull()
    return checked.withColumns({
        "fallback_reason": reason,
        "summary": F.when(ok, g["summary"]).otherwise(F.col("summary")),
        "next_steps": F.when(ok, F.slice(g["next_steps"], 1, 4)).otherwise(F.col("next_steps")),
        "talking_points": F.when(ok, F.slice(
            F.coalesce(g["talking_points"], F.array().cast("array<string>")), 1, 3)
        ).otherwise(F.col("talking_points")),
        "source": F.when(ok, "llm").otherwise("rules"),
        "model": F.when(ok, model_name),
    }).drop("__g", "__words", "invented", "numbers_ok")
