"""Table contracts and business parameters.

Every constant here is a default: operators take it as a keyword argument.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(spec: str) -> T.StructType:
    """Columns from "name type, ..."; needs no running session."""
    pairs = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_TABLES: dict[str, T.StructType] = {
    "studios": _schema(
        "studio_id string, studio_name string, address string, city string, "
        "state string, zip_code string, is_synthetic boolean"
    ),
    "members": _schema(
        "member_id string, name string, email string, phone string, gender string, "
        "dob date, home_studio_id string, join_date date, is_synthetic boolean"
    ),
    "ground_truth": _schema(
        "member_id string, cohort string, churned boolean, churn_date date, "
        "churn_risk string, is_synthetic boolean"
    ),
    "memberships": _schema(
        "membership_id string, member_id string, studio_id string, "
        "membership_tier string, monthly_price double, start_date date, "
        "end_date date, status string, is_synthetic boolean"
    ),
    "sessions": _schema(
        "session_id string, member_id string, studio_id string, session_type string, "
        "scheduled_at timestamp_ntz, attended boolean, sauna_temp_f double, "
        "is_synthetic boolean"
    ),
    "transactions": _schema(
        "transaction_id string, member_id string, studio_id string, "
        "transaction_date date, amount double, transaction_type string, "
        "status string, is_synthetic boolean"
    ),
    "app_events": _schema(
        "event_id string, member_id string, event_type string, "
        "event_timestamp timestamp_ntz, device_os string, is_synthetic boolean"
    ),
    "ai_coach_chats": _schema(
        "chat_id string, member_id string, timestamp timestamp_ntz, sender string, "
        "message_text string, is_synthetic boolean"
    ),
    "email_events": _schema(
        "email_id string, member_id string, subject string, "
        "sent_at timestamp_ntz, status string, is_synthetic boolean"
    ),
}

QUEUE_SCHEMA = _schema(
    "action_id string, member_id string, hashed_member_id string, "
    "home_studio_id string, score_date date, risk_score double, risk_tier string, "
    "action_type string, action_details string, status string, "
    "created_at timestamp_ntz, processed_at timestamp_ntz"
)
AUDIT_SCHEMA = _schema(
    "audit_id string, member_id string, hashed_member_id string, "
    "sent_at timestamp_ntz, action_type string, status string, why_score string, "
    "message_body string, error_message string"
)
AUTH_LOG_SCHEMA = _schema(
    "ts string, event string, username string, outcome string, source string, "
    "reason string, prev_hash string, hash string"
)
REGISTRY_SCHEMA = _schema(
    "version_id string, trained_at timestamp_ntz, trigger string, "
    "train_window_start date, train_window_end date, window_months int, "
    "train_rows long, val_rows long, rows_discarded_as_old long, "
    "scale_pos_weight double, val_auc double, val_pr_auc double, model_path string"
)

# Feature columns the churn model reads.
CATEGORICAL_FEATURES = ["gender", "home_studio_id", "membership_tier"]
BOOLEAN_FEATURES = ["last_recurring_payment_failed", "has_cancellation_query_30d"]
NUMERIC_FEATURES = [
    "age", "monthly_price", "tenure_days",
    "sessions_booked_7d", "sessions_booked_30d",
    "sessions_attended_7d", "sessions_attended_30d",
    "attendance_rate_7d", "attendance_rate_30d",
    "avg_sauna_temp_30d", "days_since_last_session",
    "retail_spend_30d", "failed_payments_count_30d",
    "app_logins_7d", "app_logins_30d", "metric_views_30d",
    "coach_chat_count_30d",
    "emails_sent_30d", "emails_opened_30d", "emails_clicked_30d",
    "email_open_rate_30d",
]
LABEL = "is_churned_14d"

# Thresholds, labels, words and costs that results depend on.
TIER_CUTS = {"Low": 0.20, "Medium": 0.50, "High": 0.85}
TIER_ORDER = ["Low", "Medium", "High", "Critical"]
AT_RISK_TIERS = ["Medium", "High", "Critical"]
INTENT_WORDS = ["cancel", "freeze", "terminate", "decline"]
NEVER_ATTENDED_DAYS = 999
STAGE_ORDER = [
    "onboarding", "engaged", "at_risk", "lapsed",
    "cancelled", "win_back_eligible", "win_back_expired",
]
ACTIVE_STAGES = ["onboarding", "engaged", "at_risk", "lapsed"]
CANCELLED_STAGES = ["cancelled", "win_back_eligible", "win_back_expired"]
DELIVERED = ["Sent", "DryRun"]
POSITIVE_OUTCOMES = ["re_engaged", "payment_resolved", "still_active"]
SAVED_OUTCOMES = ["re_engaged", "payment_resolved"]
CHANNEL_COSTS = {
    "Email": 0.01, "WinBackEmail": 0.01, "SMS": 0.05, "Push": 0.005, "Call": 5.00,
}
DEFAULT_CHANNEL_COST = 0.01
DAYS_PER_MONTH = 30.44
FALLBACK_LIFETIME_MONTHS = 18.0
RETENTION_EFFECTIVENESS = 0.25
WINBACK_EFFECTIVENESS = 0.08
ENGAGEMENT_WEIGHTS = {
    "session_utilization": 0.35, "app_usage": 0.25, "email_response": 0.15,
    "retail_spend": 0.15, "consistency": 0.10,
}
DRIFT_FEATURES = [
    "sessions_attended_30d", "days_since_last_session", "app_logins_30d",
    "failed_payments_count_30d", "attendance_rate_30d", "retail_spend_30d",
    "coach_chat_count_30d", "monthly_price",
]
PII_COLUMNS = ["name", "email", "phone", "phone_number", "member_id"]
GENESIS_HASH = "0" * 64
