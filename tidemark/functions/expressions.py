"""Row-level expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidemark import contracts as C


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 otherwise (null counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def count_when(condition: Column) -> Column:
    return F.sum(flag(condition))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def nan_to_null(value: Column, dtype: str) -> Column:
    """Cast, with NaN and null both becoming null."""
    as_double = value.cast("double")
    return F.when(as_double.isNull() | F.isnan(as_double), None).otherwise(value.cast(dtype))


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def percent_text(value: Column) -> Column:
    """0.123 -> '12%', halves to even."""
    return F.concat(F.bround(value * 100, 0).cast("long").cast("string"), F.lit("%"))


# --- risk -----------------------------------------------------------------

def risk_tier(p: Column, cuts: dict[str, float] = C.TIER_CUTS, top: str = "Critical") -> Column:
    (first, cut), *rest = cuts.items()
    chain = F.when(p < cut, first)
    for name, upper in rest:
        chain = chain.when(p < upper, name)
    return F.when(p.isNotNull(), chain.otherwise(top))


def _text(value: Column) -> Column:
    return value.cast("string")


def risk_reasons(
    idle_days: int = 14, min_sessions: int = 3, min_logins: int = 4, min_rate: float = 0.5
) -> Column:
    """Ordered reason array from snapshot feature columns."""
    c = F.col
    # Report wording.
    rules = [
        (c("last_recurring_payment_failed"),
         F.lit("Recurring membership fee payment FAILED.")),
        (c("failed_payments_count_30d") > 0,
         F.concat(F.lit("Had "), _text(c("failed_payments_count_30d")),
                  F.lit(" failed payment events in last 30 days."))),
        (c("has_cancellation_query_30d"),
         F.lit("Inquired in AI Coach chat about freezing/cancelling account.")),
        (c("days_since_last_session") > idle_days,
         F.concat(F.lit("Inactivity: no sauna session bookings attended for "),
                  _text(c("days_since_last_session")), F.lit(" days."))),
        (c("sessions_attended_30d") < min_sessions,
         F.concat(F.lit("Drop-off: only "), _text(c("sessions_attended_30d")),
                  F.lit(" sessions attended in the last 30 days."))),
        (c("app_logins_30d") < min_logins,
         F.concat(F.lit("Low engagement: only "), _text(c("app_logins_30d")),
                  F.lit(" app logins in the last 30 days."))),
        ((c("sessions_booked_30d") > 0) & (c("attendance_rate_30d") < min_rate),
         F.concat(F.lit("High no-show rate: booked "), _text(c("sessions_booked_30d")),
                  F.lit(" classes but attended only "),
                  percent_text(c("attendance_rate_30d")), F.lit("."))),
    ]
    found = F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))
    fallback = F.array(F.lit("General decline in email open rate and app login frequency."))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def reasons_text(**limits) -> Column:
    return F.concat_ws("; ", risk_reasons(**limits))


def snapshot_reasons(
    idle_days: int = 14, min_sessions: int = 3, min_logins: int = 4, min_rate: float = 0.5
) -> Column:
    """Headed reason array used by the member detail panel."""
    c = F.col
    # Panel wording.
    rules = [
        (c("last_recurring_payment_failed"),
         F.lit("Recurring membership payment failed")),
        (c("failed_payments_count_30d") > 0,
         F.concat(F.lit("Multiple payment failures: "), _text(c("failed_payments_count_30d")))),
        (c("has_cancellation_query_30d"), F.lit("Chat cancellation search")),
        (c("days_since_last_session") > idle_days,
         F.concat(F.lit("Extended workout inactivity: "),
                  _text(c("days_since_last_session")), F.lit(" days"))),
        (c("sessions_attended_30d") < min_sessions,
         F.concat(F.lit("Severe drop-off: "), _text(c("sessions_attended_30d")))),
        (c("app_logins_30d") < min_logins,
         F.concat(F.lit("Low app engagement: "), _text(c("app_logins_30d")))),
        ((c("sessions_booked_30d") > 0) & (c("attendance_rate_30d") < min_rate),
         F.concat(F.lit("Sauna no-show pattern: "), percent_text(c("attendance_rate_30d")))),
    ]
    found = F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General engagement decay")))


def primary_reason(idle_days: int = 14, min_sessions: int = 2) -> Column:
    """First matching reason for an action card."""
    c = F.col
    # Card wording.
    return (
        F.when(c("last_recurring_payment_failed"), "Payment failed — auto-cancel imminent")
        .when(c("has_cancellation_query_30d"), "Asked about cancellation in chat")
        .when(c("days_since_last_session") > idle_days,
              F.concat(F.lit("No sessions in "), _text(c("days_since_last_session")), F.lit(" days")))
        .when(c("sessions_attended_30d") < min_sessions,
              F.concat(F.lit("Only "), _text(c("sessions_attended_30d")), F.lit(" sessions in 30d")))
        .otherwise("Declining engagement pattern")
    )


def parse_risk_tier(why: Column, marker: str = "Tier: ") -> Column:
    """Text after the last marker, or 'Unknown'."""
    return F.when(F.contains(why, F.lit(marker)),
                  strip(F.substring_index(why, marker, -1))).otherwise("Unknown")


def has_text_intent(text: Column, words: list[str] = C.INTENT_WORDS) -> Column:
    lowered = F.lower(text)
    return either([F.contains(lowered, F.lit(w.lower())) for w in words])


# --- hashing ----------------------------------------------------------------

def salted_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def _hex_to_long(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def in_holdout(member_id: Column, salt: str, modulus: int = 10) -> Column:
    """Last four hex digits of the salted hash, one in ``modulus``."""
    return _hex_to_long(F.right(salted_hash(member_id, salt), F.lit(4))) % modulus == 0


def hash_bernoulli(member_id: Column, rate_pct: Column, suffix: str) -> Column:
    """A fixed draw per id: first eight hex digits of the suffixed hash, mod 100, below the rate."""
    return _hex_to_long(F.left(salted_hash(member_id, suffix), F.lit(8))) % 100 < rate_pct


# --- contact normalisation ---------------------------------------------------

def normalize_email(email: Column, fold_gmail: bool = False) -> Column:
    out = F.lower(strip(F.coalesce(email, F.lit(""))))
    if fold_gmail:
        local = F.regexp_replace(F.regexp_replace(F.substring_index(out, "@", 1), r"\+.*$", ""), r"\.", "")
        out = F.when(out.endswith("@gmail.com"), F.concat(local, F.lit("@gmail.com"))).otherwise(out)
    return out


def normalize_phone(phone: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"),
                  F.substring(digits, 2, 10)).otherwise(digits)


# Name suffixes dropped on request.
NAME_SUFFIXES = ["jr", "sr", "iii", "dds", "phd", "md"]


def normalize_name(name: Column, strip_suffixes: bool = False) -> Column:
    out = F.regexp_replace(F.lower(strip(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}\s]", "")
    if strip_suffixes:
        out = F.regexp_replace(out, r"\s+(" + "|".join(NAME_SUFFIXES) + r")$", "")
    return out


def rank_of(value: Column, order: list[str]) -> Column:
    """Position of a label in a fixed order, for sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)
