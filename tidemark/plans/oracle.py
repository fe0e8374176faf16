"""Check SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

from tidemark import contracts as C
from tidemark.plans.context import NOW
from tidemark.plans.oracle_base import with_blocks
from tidemark.sources.bindings import SALT

ORACLE: dict[str, str] = {}


def check(name: str, select: str) -> None:
    ORACLE[name] = with_blocks(select)


def day(col: str) -> str:
    return f"CAST({col} AS VARCHAR) AS {col.split('.')[-1]}"


def num(col: str, digits: int = 6) -> str:
    return f"round({col}, {digits}) AS {col}"


_NOW = f"TIMESTAMP '{NOW}'"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

# --- scans and sinks
check("scan_parquet", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]))
check("scan_projected", "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
check("scan_by_mode", "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
check("stage_studios", """
SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS studio_id, n_name AS studio_name,
  CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city,
  'S' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS state, CAST(NULL AS VARCHAR) AS zip_code, TRUE AS is_synthetic
FROM nation""")
check("stage_members", f"""
SELECT member_id, name, email, phone, gender, {day('dob')}, home_studio_id, {day('join_date')}, TRUE AS is_synthetic FROM members""")
check("stage_ground_truth", f"""
SELECT member_id, cohort, churned, {day('churn_date')},
  CASE CAST(substr(member_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS churn_risk,
  TRUE AS is_synthetic FROM ground_truth""")
check("stage_memberships", """
SELECT b.membership_id, b.member_id, b.studio_id, b.membership_tier, b.monthly_price,
  CAST(m.join_date AS VARCHAR) AS start_date, CAST(g.churn_date AS VARCHAR) AS end_date,
  CASE WHEN g.churned THEN 'Cancelled' ELSE 'Active' END AS status, TRUE AS is_synthetic
FROM memberships b JOIN members m USING (member_id) JOIN ground_truth g USING (member_id)""")
check("stage_sessions", f"""
SELECT session_id, member_id, studio_id, 'class' AS session_type, {_TS.format('scheduled_at')} AS scheduled_at, attended,
  sauna_temp_f, TRUE AS is_synthetic FROM sessions""")
check("stage_transactions", f"""
SELECT transaction_id, member_id, studio_id, {day('transaction_date')}, {num('amount')}, transaction_type, status, TRUE AS is_synthetic
FROM transactions""")
check("stage_app_events", f"""
SELECT event_id, member_id, event_type, {_TS.format('event_timestamp')} AS event_timestamp,
  CASE WHEN CAST(substr(event_id, 3) AS BIGINT) % 2 = 0 THEN 'ios' ELSE 'android' END AS device_os, TRUE AS is_synthetic FROM app_events""")
check("stage_ai_coach_chats", f"""
SELECT chat_id, member_id, {_TS.format('timestamp')} AS timestamp, sender, message_text, TRUE AS is_synthetic FROM chats""")
check("stage_email_events", f"""
SELECT email_id, member_id, 'News' AS subject, {_TS.format('sent_at')} AS sent_at, status, TRUE AS is_synthetic FROM emails""")
check("sink_upsert", """
SELECT hashed_member_id, stage, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM life_now WHERE stage <> 'engaged'
UNION ALL SELECT hashed_member_id, stage, CAST(snapshot_date AS VARCHAR) FROM life_before
WHERE hashed_member_id NOT IN (SELECT hashed_member_id FROM life_now WHERE stage <> 'engaged')""")

# Decisions of the churn router, used by several checks.
_RATES = """(SELECT action_type AS ch, avg(CASE WHEN outcome_30d IN ('re_engaged','payment_resolved','still_active') THEN 1.0 ELSE 0.0 END) AS pr
  FROM outcomes GROUP BY 1)"""
_RECENT = f"""(SELECT DISTINCT hashed_member_id FROM audit WHERE status IN ('Sent','DryRun') AND sent_at >= {_NOW} - INTERVAL 7 DAY)"""


def _churn(sent: str) -> str:
    return f"""
(SELECT *, CASE WHEN action_type IS NULL THEN NULL WHEN is_holdout THEN 'Holdout'
    WHEN action_type IN ('Email','SMS','Push') AND hashed_member_id IN {_RECENT} THEN 'RateLimited'
    WHEN action_type = 'Call' THEN 'Pending' ELSE '{sent}' END AS status
 FROM (SELECT *, CASE WHEN dt = 'Email' AND coalesce((SELECT pr FROM {_RATES} WHERE ch = 'Email'), 1) < 0.1 THEN 'SMS'
      WHEN dt = 'SMS' AND coalesce((SELECT pr FROM {_RATES} WHERE ch = 'SMS'), 1) < 0.1 THEN 'Call' ELSE dt END AS action_type
   FROM (SELECT s.hashed_member_id, i.member_id, i.name, i.phone, f.home_studio_id, s.score_date, s.churn_probability AS risk_score, s.risk_tier, h.is_holdout,
       CASE s.risk_tier WHEN 'Medium' THEN 'Email' WHEN 'High' THEN 'SMS' WHEN 'Critical' THEN 'Call' END AS dt,
       CASE s.risk_tier WHEN 'Medium' THEN 'Send: Re-engagement promotions & new class highlights email.'
         WHEN 'High' THEN 'Send: Push notification or personal SMS.'
         WHEN 'Critical' THEN 'Action: Studio staff personal outreach call required immediately.' END AS details
     FROM scores s JOIN identity i USING (hashed_member_id) LEFT JOIN snap f USING (hashed_member_id) JOIN holdout h USING (member_id))))"""


_D = _churn("DryRun")
check("sink_status_update", f"""
SELECT action_type, CASE WHEN status = 'Pending' THEN 'Sent' ELSE status END AS status, count(*) AS actions, count(*) AS processed
FROM {_D} WHERE status IS NOT NULL GROUP BY 1, 2""")
check("status_update_audit", f"""
SELECT member_id, action_type, 'Sent' AS status, 'Manual Outreach | Outcome: No Answer' AS why_score,
  'Outcome: No Answer | Notes: ' AS message_body FROM {_D} WHERE status = 'Pending'""")
check("encrypt_pii_columns", "SELECT member_id, hashed_member_id, name, email, phone FROM identity")

# --- projections and filters
check("latest_snapshot", f"""
SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {num('value')} FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
_SC = f"hashed_member_id, {day('score_date')}, {num('churn_probability')}, risk_tier"
check("risk_tier", f"SELECT {_SC} FROM scores")
_PCT = "CAST(CAST(round_even(attendance_rate_30d * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_REASONS = f"""coalesce(nullif(concat_ws('; ',
  CASE WHEN last_recurring_payment_failed THEN 'Recurring membership fee payment FAILED.' END,
  CASE WHEN failed_payments_count_30d > 0 THEN 'Had ' || failed_payments_count_30d || ' failed payment events in last 30 days.' END,
  CASE WHEN has_cancellation_query_30d THEN 'Inquired in AI Coach chat about freezing/cancelling account.' END,
  CASE WHEN days_since_last_session > 14 THEN 'Inactivity: no sauna session bookings attended for ' || days_since_last_session || ' days.' END,
  CASE WHEN sessions_attended_30d < 3 THEN 'Drop-off: only ' || sessions_attended_30d || ' sessions attended in the last 30 days.' END,
  CASE WHEN app_logins_30d < 4 THEN 'Low engagement: only ' || app_logins_30d || ' app logins in the last 30 days.' END,
  CASE WHEN sessions_booked_30d > 0 AND attendance_rate_30d < 0.5 THEN 'High no-show rate: booked ' || sessions_booked_30d
    || ' classes but attended only ' || {_PCT} || '.' END), ''), 'General decline in email open rate and app login frequency.')"""
check("risk_reasons", f"SELECT hashed_member_id, {_REASONS} AS reasons FROM snap")
check("snapshot_reasons", f"""
SELECT hashed_member_id, coalesce(nullif(concat_ws(' | ',
  CASE WHEN last_recurring_payment_failed THEN 'Recurring membership payment failed' END,
  CASE WHEN failed_payments_count_30d > 0 THEN 'Multiple payment failures: ' || failed_payments_count_30d END,
  CASE WHEN has_cancellation_query_30d THEN 'Chat cancellation search' END,
  CASE WHEN days_since_last_session > 14 THEN 'Extended workout inactivity: ' || days_since_last_session || ' days' END,
  CASE WHEN sessions_attended_30d < 3 THEN 'Severe drop-off: ' || sessions_attended_30d END,
  CASE WHEN app_logins_30d < 4 THEN 'Low app engagement: ' || app_logins_30d END,
  CASE WHEN sessions_booked_30d > 0 AND attendance_rate_30d < 0.5 THEN 'Sauna no-show pattern: ' || {_PCT} END), ''),
  'General engagement decay') AS reasons FROM snap""")
_PRIMARY = """CASE WHEN last_recurring_payment_failed THEN 'Payment failed — auto-cancel imminent'
  WHEN has_cancellation_query_30d THEN 'Asked about cancellation in chat'
  WHEN days_since_last_session > 14 THEN 'No sessions in ' || days_since_last_session || ' days'
  WHEN sessions_attended_30d < 2 THEN 'Only ' || sessions_attended_30d || ' sessions in 30d'
  ELSE 'Declining engagement pattern' END"""
check("primary_reason", f"SELECT hashed_member_id, {_PRIMARY} AS reason FROM snap")
check("has_text_intent", """
SELECT conv_id, turn, lower(text) LIKE '%thion%' OR lower(text) LIKE '%ch%' OR lower(text) LIKE '%eau%' AS intent,
  lower(text) LIKE '%cancel%' OR lower(text) LIKE '%freeze%' OR lower(text) LIKE '%terminate%' OR lower(text) LIKE '%decline%' AS cancel_intent
FROM conversations""")
check("parse_risk_tier", "SELECT audit_id, split_part(why_score, 'Tier: ', 2) AS risk_tier, 'Unknown' AS unmarked FROM audit")
check("status_filter", "SELECT audit_id, status FROM audit WHERE status IN ('Sent','DryRun')")
check("scope_to_studio", """
SELECT 'features' AS frame, count(*) AS rows, count(DISTINCT hashed_member_id) AS members FROM mart WHERE home_studio_id = 'S07'
UNION ALL SELECT 'identity', count(*), count(DISTINCT hashed_member_id) FROM identity
  WHERE hashed_member_id IN (SELECT hashed_member_id FROM mart WHERE home_studio_id = 'S07')
UNION ALL SELECT 'scores', count(*), count(DISTINCT hashed_member_id) FROM scores
  WHERE hashed_member_id IN (SELECT hashed_member_id FROM mart WHERE home_studio_id = 'S07')""")
_NUMBERED = """(SELECT *, row_number() OVER (PARTITION BY hashed_member_id ORDER BY date_day) AS day_no,
  row_number() OVER (PARTITION BY hashed_member_id ORDER BY date_day DESC) AS from_end FROM mart)"""
check("member_lookup", f"""
SELECT i.member_id, i.name, {day('date_day')}, day_no, tenure_days, sessions_attended_30d
FROM {_NUMBERED} JOIN identity i USING (hashed_member_id) WHERE i.member_id = 'M0000000007' AND (day_no <= 5 OR from_end <= 10)""")
check("first_last_days", f"""
SELECT hashed_member_id, {day('date_day')}, day_no FROM {_NUMBERED} WHERE day_no <= 5 OR from_end <= 10""")
check("search_members", "SELECT member_id, name FROM identity ORDER BY name, member_id")
check("nan_to_null", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(trunc(value) AS INTEGER) END AS value FROM events""")

# --- daily aggregates and the panel
check("daily_sessions", f"SELECT * REPLACE ({day('event_date')}, {num('temp_sum')}) FROM daily_sessions")
check("daily_transactions", f"SELECT * REPLACE ({day('event_date')}, {num('retail_spend')}) FROM daily_transactions")
for _t in ("daily_app_events", "daily_chats", "daily_emails"):
    check(_t, f"SELECT * REPLACE ({day('event_date')}) FROM {_t}")
check("as_of_date", f"SELECT {day('as_of_date')} FROM config")
_PANEL = ("* REPLACE (" + ", ".join([day("date_day"), *map(num, [
    "age", "monthly_price", "attendance_rate_7d", "attendance_rate_30d", "avg_sauna_temp_30d", "retail_spend_30d",
    "email_open_rate_30d"])]) + ")")
check("member_features_daily", f"SELECT {_PANEL} FROM mart")
check("member_features_incremental", f"SELECT {_PANEL} FROM mart WHERE date_day >= DATE '2024-01-26'")
check("member_features_since", f"SELECT {_PANEL} FROM mart WHERE date_day >= DATE '2024-01-26'")
check("member_state_daily", f"SELECT {_PANEL} FROM mart WHERE date_day = DATE '2024-01-27'")
check("member_features_snapshot", f"SELECT {_PANEL} FROM snap")
check("member_features_snapshot_earlier", f"SELECT {_PANEL} FROM snap_before")
check("rolling_sum_7d", f"""
SELECT hashed_member_id, {day('date_day')}, sessions_booked_7d, sessions_attended_7d, app_logins_7d FROM mart""")
check("rolling_sum_30d", f"""
SELECT {day('date_day')}, CAST(sum(sessions_booked_30d) AS BIGINT) AS booked, round(sum(retail_spend_30d), 6) AS retail,
  CAST(sum(app_logins_30d) AS BIGINT) AS logins, CAST(sum(emails_opened_30d) AS BIGINT) AS opened FROM mart GROUP BY date_day""")
check("last_attended_date", f"""
SELECT i.hashed_member_id, {day('date_day')}, CAST(last_att AS VARCHAR) AS last_attended
FROM rolled JOIN identity i USING (member_id) WHERE last_att IS NOT NULL""")
check("last_payment_status", f"""
SELECT {day('date_day')}, count(*) FILTER (last_recurring_payment_failed) AS members_failed FROM mart GROUP BY date_day""")
check("member_identity", "SELECT member_id, hashed_member_id, name, email, phone FROM identity")
check("inactive_members", "SELECT member_id FROM identity WHERE hashed_member_id NOT IN (SELECT hashed_member_id FROM snap)")

# --- scored reports
check("scored_features", f"""
SELECT hashed_member_id, CAST(s.score_date AS VARCHAR) AS score_date, round(s.churn_probability, 6) AS churn_probability,
  f.home_studio_id, f.monthly_price FROM scores s JOIN snap f USING (hashed_member_id)""")
check("risk_kpis", """
SELECT count(DISTINCT s.hashed_member_id) AS total_active, count(*) FILTER (s.risk_tier IN ('Medium','High','Critical')) AS at_risk,
  round(sum(s.churn_probability), 6) AS churn_forecast, sum(CASE WHEN s.churn_probability >= 0.5 THEN f.monthly_price ELSE 0 END) AS mrr_at_risk
FROM scores s JOIN snap f USING (hashed_member_id)""")
check("risk_distribution", """
SELECT risk_tier, count(*) AS members, CASE risk_tier WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS tier_order
FROM scores GROUP BY 1 ORDER BY 3""")
check("risk_histogram", """
SELECT least(CAST(floor(churn_probability * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS members FROM scores GROUP BY 1""")
check("studio_risk_breakdown", """
SELECT f.home_studio_id AS studio, count(DISTINCT s.hashed_member_id) AS active_members,
  count(*) FILTER (s.risk_tier = 'Critical') AS critical_count, count(*) FILTER (s.risk_tier = 'High') AS high_count,
  count(*) FILTER (s.risk_tier = 'Medium') AS medium_count, round(avg(s.churn_probability) * 100, 2) AS avg_risk_pct,
  round(sum(s.churn_probability), 1) AS expected_churn_count
FROM scores s JOIN snap f USING (hashed_member_id) GROUP BY 1""")
check("top_k_at_risk", f"""
SELECT f.hashed_member_id, i.member_id, i.name, i.email, f.home_studio_id, f.membership_tier,
  round(s.churn_probability, 6) AS churn_probability, s.risk_tier, {_REASONS} AS reasons
FROM scores s JOIN snap f USING (hashed_member_id) JOIN identity i USING (hashed_member_id)
ORDER BY s.churn_probability DESC, f.hashed_member_id LIMIT 20""")
check("priority_actions", f"""
SELECT f.hashed_member_id, i.member_id, i.name, round(s.churn_probability, 6) AS churn_probability, s.risk_tier, f.membership_tier,
  f.monthly_price, f.tenure_days, f.days_since_last_session, f.sessions_attended_30d, {_PRIMARY} AS primary_reason
FROM scores s JOIN snap f USING (hashed_member_id) JOIN identity i USING (hashed_member_id)
WHERE s.risk_tier IN ('Medium','High','Critical') ORDER BY s.churn_probability DESC, f.hashed_member_id LIMIT 5""")
check("demo_member_pick", """
SELECT hashed_member_id, has_cancellation_query_30d, round(churn_probability, 6) AS churn_probability
FROM scores JOIN snap USING (hashed_member_id)
ORDER BY CASE WHEN has_cancellation_query_30d THEN 1 ELSE 0 END DESC, scores.churn_probability DESC, hashed_member_id LIMIT 1""")
check("latest_by_key", f"""
SELECT user_id, event_id, event_type, {num('value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
check("last_n_per_key", """
SELECT conv_id AS member_key, turn, CASE role WHEN 'user' THEN 'member' WHEN 'assistant' THEN 'coach' ELSE role END AS sender,
  length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position
FROM conversations QUALIFY position <= 8""")
check("dedup_first", """
SELECT hashed_member_id, stage, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM
  (SELECT hashed_member_id, stage, snapshot_date FROM life_now UNION ALL SELECT hashed_member_id, stage, snapshot_date FROM life_before)
QUALIFY row_number() OVER (PARTITION BY hashed_member_id ORDER BY snapshot_date DESC) = 1""")

# --- lifecycle and engagement
_LIFE = f"* REPLACE ({day('snapshot_date')}, {num('churn_probability')}, CAST(days_since_last_session AS BIGINT) AS days_since_last_session)"
check("lifecycle_stage", f"SELECT {_LIFE} FROM life_now")
check("stage_transition", f"SELECT {_LIFE[:-1]}, {day('stage_entered_at')}) FROM lifecycle")
check("stage_transition_days", """
SELECT hashed_member_id, stage, CAST(snapshot_date - stage_entered_at AS INTEGER) AS days_in_stage FROM lifecycle""")
check("stage_distribution", """
SELECT stage, count(*) AS members, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct,
  list_position(['onboarding','engaged','at_risk','lapsed','cancelled','win_back_eligible','win_back_expired'], stage) AS stage_order
FROM life_now GROUP BY stage""")
check("stage_transitions", """
SELECT previous_stage, stage, count(*) AS members FROM lifecycle WHERE previous_stage <> stage GROUP BY 1, 2""")
check("winback_opportunity", """
SELECT count(*) AS members, coalesce(sum(monthly_price), 0) AS monthly_revenue FROM life_now WHERE stage = 'win_back_eligible'""")
check("reengaged_count", """
SELECT count(*) FILTER (previous_stage IN ('at_risk','lapsed') AND stage = 'engaged') AS reengaged FROM lifecycle""")
check("engagement_score", f"SELECT * REPLACE ({num('churn_probability')}) FROM engagement")
check("engagement_segment", "SELECT membership_tier, segment, count(*) AS members FROM engagement GROUP BY 1, 2")
check("segment_summary", """
SELECT segment, count(*) AS members, round_even(round(avg(engagement_score), 9), 2) AS avg_engagement,
  round_even(round(avg(churn_probability), 9), 2) AS avg_churn_risk, round_even(sum(monthly_price), 2) AS monthly_revenue FROM engagement GROUP BY 1""")
check("engagement_quadrant", """
SELECT CASE WHEN coalesce(churn_probability, 0) * 100 >= 50 THEN CASE WHEN engagement_score < 50 THEN 'CRITICAL OUTREACH' ELSE 'VULNERABLE ENGAGED' END
  WHEN engagement_score < 50 THEN 'UNDER-ENGAGED / PASSIVE' ELSE 'HEALTHY / CHAMPIONS' END AS quadrant,
  count(*) AS members, sum(monthly_price) AS monthly_revenue FROM engagement GROUP BY 1""")
check("tier_mismatch_check", """
SELECT count(*) FILTER (segment = 'upsell_candidate') AS upsell_members,
  coalesce(bool_and(membership_tier = 'Basic') FILTER (segment = 'upsell_candidate'), TRUE) AS upsell_all_basic,
  count(*) FILTER (segment = 'under_engaged_payer') AS under_engaged_members,
  coalesce(bool_and(membership_tier = 'Premium') FILTER (segment = 'under_engaged_payer'), TRUE) AS under_all_premium,
  coalesce(sum(monthly_price) FILTER (segment = 'upsell_candidate'), 0.0) AS upsell_pipeline_mrr FROM engagement""")

# --- outcomes and revenue
check("intervention_outcomes", f"""
SELECT * REPLACE ({day('intervention_date')}, {day('re_engaged_date')}, {day('payment_resolved_date')}) FROM outcomes""")
_POS = "(CASE WHEN outcome_30d IN ('re_engaged','payment_resolved','still_active') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
check("conversion_rates", f"""
SELECT action_type, risk_tier, CASE WHEN grouping(risk_tier) = 1 THEN 'by_channel' WHEN grouping(action_type) = 1 THEN 'by_tier' ELSE 'by_channel_tier' END AS grouping,
  count(audit_id) AS total, count(*) FILTER (outcome_30d = 're_engaged') AS re_engaged,
  count(*) FILTER (outcome_30d = 'payment_resolved') AS payment_resolved, count(*) FILTER (outcome_30d = 'churned') AS churned,
  round_even(avg({_POS}), 3) AS positive_rate
FROM outcomes GROUP BY GROUPING SETS ((action_type), (risk_tier), (action_type, risk_tier))""")
check("channel_effectiveness", f"""
SELECT action_type, count(*) AS total, CAST(sum({_POS}) AS BIGINT) AS positive, round(avg({_POS}), 6) AS positive_rate,
  round_even(sum({_POS}) / count(*) * 100, 1) AS rate_pct FROM outcomes GROUP BY 1""")
check("outcome_distribution", """
SELECT outcome_30d, count(*) AS interventions, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM outcomes GROUP BY 1""")
check("treated_members", """
SELECT hashed_member_id, touches, is_lost, confirmed_save, primary_channel, monthly_price, home_studio_id,
  round(churn_probability, 6) AS churn_probability, stage, segment, effectiveness, round(targeted_mrr, 6) AS targeted_mrr,
  round(targeted_mrr * effectiveness, 6) AS saved_mrr, round(churn_probability * effectiveness, 6) AS saved_members_exp, lost_mrr
FROM treated""")
_LIFETIME = """(SELECT coalesce(round_even(avg(churn_date - join_date) FILTER (churn_date > join_date) / 30.44, 1), 18.0) AS avg_lifetime_months
  FROM o_members WHERE churned)"""
check("avg_lifetime_months", f"SELECT avg_lifetime_months FROM {_LIFETIME}")
check("revenue_summary", f"""
SELECT members_treated, round(es, 1) AS est_members_saved, confirmed_reengaged, members_lost, round(risk, 2) AS mrr_at_risk,
  round(saved, 2) AS saved_mrr, round(lost, 2) AS lost_mrr, round(spend, 2) AS intervention_spend, round(saved - spend, 2) AS net_monthly_impact,
  alm AS avg_lifetime_months, round(saved * alm, 2) AS ltv_impact, 0.25 AS retention_effectiveness, 0.08 AS winback_rate,
  CASE WHEN spend > 0 THEN round((saved - spend) / spend, 1) END AS roi_ratio
FROM (SELECT count(DISTINCT hashed_member_id) AS members_treated, sum(churn_probability * effectiveness) AS es,
    count(*) FILTER (confirmed_save) AS confirmed_reengaged, count(*) FILTER (is_lost) AS members_lost, sum(targeted_mrr) AS risk,
    sum(targeted_mrr * effectiveness) AS saved, sum(lost_mrr) AS lost, (SELECT CAST(sum(cost) AS DOUBLE) FROM costed) AS spend,
    (SELECT avg_lifetime_months FROM {_LIFETIME}) AS alm FROM treated)""")
check("channel_roi", """
SELECT c.channel, sends, cost, coalesce(members_saved, 0) AS members_saved, coalesce(saved_mrr, 0) AS saved_mrr,
  round(coalesce(saved_mrr, 0) - cost, 2) AS net_monthly, CASE WHEN cost > 0 THEN round((coalesce(saved_mrr, 0) - cost) / cost, 1) END AS roi_ratio
FROM (SELECT action_type AS channel, count(*) AS sends, CAST(round(sum(cost), 2) AS DOUBLE) AS cost FROM costed GROUP BY 1) c
LEFT JOIN (SELECT primary_channel AS channel, round(sum(churn_probability * effectiveness), 1) AS members_saved,
  round(sum(targeted_mrr * effectiveness), 2) AS saved_mrr FROM treated GROUP BY 1) s USING (channel)""")
check("studio_leaderboard", """
SELECT b.*, coalesce(CAST(round(sp.s, 2) AS DOUBLE), 0.0) AS spend, round(saved_mrr - coalesce(CAST(round(sp.s, 2) AS DOUBLE), 0.0), 2) AS net_monthly,
  row_number() OVER (ORDER BY round(saved_mrr - coalesce(CAST(round(sp.s, 2) AS DOUBLE), 0.0), 2) DESC, b.home_studio_id) AS rank
FROM (SELECT home_studio_id, count(DISTINCT hashed_member_id) AS members_treated, round(sum(churn_probability * effectiveness), 2) AS est_saved,
    count(*) FILTER (is_lost) AS members_lost, round(sum(targeted_mrr), 2) AS mrr_at_risk, round(sum(targeted_mrr * effectiveness), 2) AS saved_mrr,
    round(sum(lost_mrr), 2) AS lost_mrr FROM treated WHERE home_studio_id IS NOT NULL GROUP BY 1) b
LEFT JOIN (SELECT l.home_studio_id, sum(c.cost) AS s FROM costed c JOIN life_now l USING (hashed_member_id) GROUP BY 1) sp
  ON sp.home_studio_id = b.home_studio_id""")
check("km_retention", """
SELECT month, round(exp(sum(ln(greatest(step, 1e-300))) OVER (ORDER BY month)), 4) AS retention, at_risk
FROM (SELECT m AS month, count(*) FILTER (dur >= m - 1) AS at_risk,
    CASE WHEN count(*) FILTER (dur >= m - 1) > 0
      THEN 1 - count(*) FILTER (churned AND dur >= m - 1 AND dur < m) / CAST(count(*) FILTER (dur >= m - 1) AS DOUBLE) ELSE 1.0 END AS step
  FROM (SELECT churned, greatest((coalesce(churn_date, (SELECT as_of_date FROM o_as_of)) - join_date) / 30.44, 0) AS dur FROM o_members),
    range(1, 85) t(m) GROUP BY m)""")
_REACT = """(SELECT sha256(CAST(k AS VARCHAR)) AS hashed_member_id, CAST(k AS VARCHAR) AS member_id, 'S' || lpad(CAST(nk AS VARCHAR), 2, '0') AS home_studio_id,
  59.0 AS monthly_price, bool_or(before = FALSE AND hit) AS reactivated, min(CASE WHEN before = FALSE AND hit THEN y || '-12-31' END) AS reactivated_at
FROM (SELECT k, nk, y, hit, coalesce(lag(hit) OVER (PARTITION BY k ORDER BY y), TRUE) AS before
  FROM (SELECT c_custkey AS k, c_nationkey AS nk, y, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y) AS hit
    FROM customer, (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders)))
GROUP BY k, nk HAVING bool_or(NOT hit))"""
check("hash_bernoulli", "SELECT member_id, CAST('0x' || left(sha256(member_id || 'survey'), 8) AS BIGINT) % 100 < 15 AS drawn FROM identity")
_BOARD = f"""(SELECT home_studio_id, eligible, reactivated, recovered_mrr, reactivation_rate, recovered_annual,
    CASE WHEN sum(recovered_annual) OVER () > 0 THEN round(recovered_annual / sum(recovered_annual) OVER () * (sum(recovered_annual) OVER () * 0.1), 2) ELSE 0 END AS bonus_award,
    row_number() OVER (ORDER BY reactivation_rate DESC, recovered_mrr DESC, home_studio_id) AS rank
  FROM (SELECT *, round_even(reactivated / CAST(eligible AS DOUBLE), 3) AS reactivation_rate, round(recovered_mrr * 12, 2) AS recovered_annual
    FROM (SELECT home_studio_id, count(*) AS eligible, count(*) FILTER (reactivated) AS reactivated,
      round(coalesce(sum(monthly_price) FILTER (reactivated), 0.0), 2) AS recovered_mrr FROM {_REACT} GROUP BY 1)))"""
check("winback_leaderboard", f"SELECT * FROM {_BOARD}")
check("bonus_pool", f"""
SELECT round(coalesce(sum(recovered_annual), 0) * 0.1, 2) AS bonus_pool, round(coalesce(sum(recovered_annual), 0), 2) AS total_recovered_annual,
  arg_min(home_studio_id, rank) AS champion_studio, coalesce(arg_min(reactivation_rate, rank), 0) AS champion_rate FROM {_BOARD}""")
check("studio_rank", f"""
SELECT home_studio_id, rank, count(*) OVER () AS of, reactivation_rate, reactivated, eligible, recovered_mrr, bonus_award FROM {_BOARD}""")
check("observed_reactivations", f"SELECT * FROM {_REACT}")
check("studio_health", f"""
SELECT home_studio_id, n AS active_members, round(rr, 6) AS retention_rate, round(os, 6) AS outcome_success,
  CAST(greatest(0, least(100, floor(round(rr * 0.5 + os * 0.3 + least(100, rr * 1.1) * 0.2, 9)))) AS INTEGER) AS health_score
FROM (SELECT f.home_studio_id, count(*) AS n, (count(*) - count(*) FILTER (s.risk_tier <> 'Low')) / CAST(count(*) AS DOUBLE) * 100 AS rr,
    (SELECT avg({_POS}) * 100 FROM outcomes) AS os FROM scores s JOIN snap f USING (hashed_member_id) GROUP BY 1)""")

# --- routing
check("holdout_assignment", "SELECT member_id, is_holdout FROM holdout")
check("cooldown_filter", f"SELECT member_id FROM identity WHERE hashed_member_id NOT IN {_RECENT}")
check("channel_escalation", f"""
SELECT action_type, CASE WHEN action_type = 'Email' AND coalesce((SELECT pr FROM {_RATES} WHERE ch = 'Email'), 1) < 0.99 THEN 'SMS'
  WHEN action_type = 'SMS' AND coalesce((SELECT pr FROM {_RATES} WHERE ch = 'SMS'), 1) < 0.99 THEN 'Call' ELSE action_type END AS escalated_to,
  count(*) AS actions FROM audit GROUP BY 1, 2""")
_WHY = "'Score: ' || printf('%.4f', risk_score) || ' | Tier: ' || risk_tier"
_MSG = """CASE risk_tier WHEN 'Medium' THEN 'Hi ' || name || ', we noticed you haven''t booked a session lately! Check out our new virtual trainers and book a slot today.'
  WHEN 'High' THEN 'Hey ' || name || '! It''s your coach at your studio. We miss you in the sauna! Here''s a voucher for a free retail recovery drink on your next session: RECOVERY.'
  WHEN 'Critical' THEN 'URGENT: Call ' || name || ' (' || phone || ') to resolve account issues (e.g. failed payment or cancellation inquiries).' END"""
check("route_churn_actions", f"""
SELECT hashed_member_id, member_id, home_studio_id, {day('score_date')}, {num('risk_score')}, risk_tier, action_type,
  CASE WHEN action_type <> dt THEN '[ESCALATED from ' || dt || '] ' ELSE '' END || details || CASE status WHEN 'Holdout' THEN ' (Holdout Group: Untreated)'
    WHEN 'RateLimited' THEN ' (Rate Limited: Skipped)' ELSE '' END AS action_details,
  status, {_WHY} AS why_score, {_MSG} AS message_body, coalesce(action_type <> dt, FALSE) AS escalated FROM {_D}""")
check("churn_audit_rows", f"""
SELECT 'AUr1' || left(hashed_member_id, 16) AS audit_id, member_id, hashed_member_id, '{NOW}' AS sent_at, action_type, status,
  {_WHY} AS why_score, '' AS error_message FROM {_D} WHERE status IS NOT NULL AND status <> 'RateLimited'""")
_PRIOR = f"(SELECT count(*) FROM audit WHERE status = 'Sent' AND sent_at >= {_NOW} - INTERVAL 1 HOUR)"
check("send_cap", f"""
SELECT hashed_member_id, round(risk_score, 6) AS risk_score, action_type, CASE WHEN before_me + {_PRIOR} >= 50 AND counted THEN NULL ELSE status END AS status,
  counted AS counts_to_cap
FROM (SELECT *, coalesce(sum(CASE WHEN counted THEN 1 ELSE 0 END) OVER (ORDER BY risk_score DESC, hashed_member_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_me,
    coalesce(max(CASE WHEN counted AND lv > 50 - {_PRIOR} THEN 1 ELSE 0 END) OVER (ORDER BY risk_score DESC, hashed_member_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
  FROM (SELECT *, sum(CASE WHEN counted THEN 1 ELSE 0 END) OVER (ORDER BY risk_score DESC, hashed_member_id) AS lv
    FROM (SELECT *, coalesce(action_type IN ('Email','SMS') AND status = 'Sent', FALSE) AS counted FROM {_churn('Sent')})))
WHERE stopped = 0""")
_LNAME = "coalesce(i.name, 'Member')"
check("route_lifecycle_actions", f"""
SELECT l.hashed_member_id, l.member_id, l.home_studio_id, CAST(l.snapshot_date AS VARCHAR) AS score_date, round(l.churn_probability, 6) AS risk_score, l.risk_tier,
  CASE WHEN l.stage = 'onboarding' THEN 'OnboardingEmail' WHEN days_in_stage <= 14 THEN 'WinBackEmail' WHEN days_in_stage <= 45 THEN 'WinBackSMS' ELSE 'WinBackEmail' END AS action_type,
  CASE WHEN l.stage = 'onboarding' THEN CASE WHEN l.tenure_days <= 3 THEN 'Onboarding Day 1-3: Welcome email with first session booking CTA.'
      WHEN l.tenure_days <= 7 THEN 'Onboarding Day 4-7: First-week check-in + session reminder.'
      ELSE 'Onboarding Day 8-14: Habit formation nudge + app feature highlight.' END
    ELSE 'Win-Back (Early): ''We miss you'' email with limited-time rejoin offer.' END AS action_details,
  'DryRun' AS status, 'Lifecycle: ' || l.stage || ' | Tenure: ' || l.tenure_days || 'd' AS why_score,
  CASE WHEN l.stage = 'onboarding' THEN CASE
      WHEN l.tenure_days <= 3 THEN 'Welcome to the your studio family, ' || {_LNAME} || '! Your infrared sauna journey starts now. Book your first session today and experience the burn! Tip: start with Hot Yoga or Hot Pilates for a great first experience.'
      WHEN l.tenure_days <= 7 THEN 'Hey ' || {_LNAME} || ', how was your first week at your studio? If you haven''t booked yet, now''s the perfect time! Members who attend 3+ sessions in their first month are 5x more likely to achieve their fitness goals. Let''s get started!'
      ELSE 'Hi ' || {_LNAME} || ', you''re building a great routine! Did you know the your studio app tracks your workout metrics in real-time? Check your performance stats after your next session and watch your progress grow.' END
    ELSE 'Hey ' || {_LNAME} || ', we noticed you left the your studio family and we miss you! Come back and get your first month FREE — no rejoin fee. This offer expires in 14 days. Book a complimentary session to see what''s new!' END AS message_body,
  FALSE AS escalated
FROM lifecycle l LEFT JOIN identity i USING (hashed_member_id)
WHERE ((l.stage = 'onboarding' AND l.tenure_days <= 14) OR l.stage = 'win_back_eligible') AND l.hashed_member_id NOT IN {_RECENT}""")
check("route_segment_actions", f"""
SELECT hashed_member_id, member_id, home_studio_id, '{NOW[:10]}' AS score_date, round(coalesce(churn_probability, 0), 6) AS risk_score, segment AS risk_tier, action_type,
  '[' || segment || '] eng=' || CAST(engagement_score AS VARCHAR) || ': ' || details AS action_details, status,
  'Engagement ' || CAST(engagement_score AS VARCHAR) || ' | Segment: ' || segment AS why_score,
  CASE WHEN status = 'Holdout' THEN '' ELSE body END AS message_body, FALSE AS escalated
FROM (SELECT *, CASE WHEN action_type IS NULL THEN NULL WHEN is_holdout THEN 'Holdout' WHEN hashed_member_id IN {_RECENT} THEN 'RateLimited' ELSE 'DryRun' END AS status
  FROM (SELECT e.*, i.member_id, i.name, h.is_holdout,
    CASE segment WHEN 'upsell_candidate' THEN 'UpsellEmail' WHEN 'under_engaged_payer' THEN 'WinValueEmail' WHEN 'at_risk_silent' THEN 'EngageNudge' WHEN 'champion' THEN 'ReferralEmail' END AS action_type,
    CASE segment WHEN 'upsell_candidate' THEN 'Pitch VIP/Premium upgrade to a highly-engaged Basic member.' WHEN 'under_engaged_payer' THEN 'Re-engage / right-size a low-usage Premium member.'
      WHEN 'at_risk_silent' THEN 'Proactive nudge to a silent, low-engagement member.' WHEN 'champion' THEN 'Referral / promoter ask to a highly-engaged member.' END AS details,
    CASE segment WHEN 'upsell_candidate' THEN 'Hi ' || i.name || ', you''re crushing your workouts on the ' || membership_tier || ' plan! Members like you get the most from VIP — unlimited priority booking and exclusive sessions. Upgrade this week and your first month is 50% off.'
      WHEN 'under_engaged_payer' THEN 'Hi ' || i.name || ', your ' || membership_tier || ' membership unlocks our full studio — and we''ve missed you! Let''s get you back on track: reply and we''ll build you a simple 2-sessions-a-week plan (or help you find the plan that fits).'
      WHEN 'at_risk_silent' THEN 'Hi ' || i.name || ', it''s been a while! New virtual trainers and classes just dropped. Book your comeback session and we''ll have a recovery drink waiting.'
      WHEN 'champion' THEN 'Hi ' || i.name || ', you''re a your studio champion! Refer a friend and you BOTH get a free month. Share your code and keep the streak going.' END AS body
    FROM engagement e JOIN identity i USING (hashed_member_id) JOIN holdout h USING (member_id)))""")
check("dispatch_stats", f"""
SELECT count(*) AS evaluated, count(*) FILTER (action_type IS NULL) AS no_action, count(*) FILTER (status = 'Holdout') AS holdout,
  count(*) FILTER (status = 'RateLimited') AS rate_limited, count(*) FILTER (status IN ('Sent','DryRun')) AS sent,
  count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (action_type <> dt) AS escalated FROM {_D}""")
check("sends_last_hour", f"""
SELECT action_type, count(*) AS sends FROM audit WHERE sent_at >= {_NOW} - INTERVAL 1 HOUR GROUP BY 1""")
_ARMS = """(SELECT DISTINCT a.member_id, CASE WHEN status = 'Holdout' THEN 'h' ELSE 't' END AS arm, g.churned FROM audit a JOIN ground_truth g USING (member_id))"""
_AB = f"""(SELECT count(*) FILTER (arm = 'h') AS n_holdout, count(*) FILTER (arm = 't') AS n_treatment,
  count(*) FILTER (arm = 'h' AND churned) AS churned_holdout, count(*) FILTER (arm = 't' AND churned) AS churned_treatment FROM {_ARMS})"""
check("ab_lift", f"""
SELECT n_holdout, n_treatment, churned_holdout, churned_treatment, round(rh, 6) AS rate_holdout, round(rt, 6) AS rate_treatment,
  round(rh - rt, 6) AS lift, round(CASE WHEN rh > 0 THEN (rh - rt) / rh END, 6) AS relative_lift
FROM (SELECT *, CASE WHEN n_holdout > 0 THEN churned_holdout / CAST(n_holdout AS DOUBLE) END AS rh,
  CASE WHEN n_treatment > 0 THEN churned_treatment / CAST(n_treatment AS DOUBLE) END AS rt FROM {_AB})""")
check("ab_significance", f"""
SELECT n_holdout, n_treatment, round(x, 6) AS chi_square, round(p, 4) AS p_value, p < 0.05 AS significant
FROM (SELECT *, 1 - 2 / sqrt(pi()) * (SELECT sum(exp(-pow((i + 0.5) * sqrt(x / 2) / 20000, 2))) FROM range(0, 20000) t(i)) * sqrt(x / 2) / 20000 AS p
  FROM (SELECT *, (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS x
    FROM (SELECT *, CAST(churned_holdout AS DOUBLE) AS a, CAST(n_holdout - churned_holdout AS DOUBLE) AS b,
      CAST(churned_treatment AS DOUBLE) AS c, CAST(n_treatment - churned_treatment AS DOUBLE) AS d FROM {_AB})))""")
check("ab_saved_revenue", f"""
SELECT n_treatment, round(churned_holdout / CAST(n_holdout AS DOUBLE) - churned_treatment / CAST(n_treatment AS DOUBLE), 6) AS lift,
  round(p, 6) AS avg_monthly_price, round(n_treatment * (churned_holdout / CAST(n_holdout AS DOUBLE) - churned_treatment / CAST(n_treatment AS DOUBLE)) * p, 6) AS saved_revenue
FROM {_AB}, (SELECT avg(monthly_price) AS p FROM {_ARMS} JOIN memberships USING (member_id) WHERE arm = 't')""")
check("ab_assignment_stability", """
SELECT CAST(o_custkey AS VARCHAR) AS member_id FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
_P = "CAST(CAST(round_even(churn_probability * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_TASKS = f"""(SELECT t.home_studio_id, kind, position, t.hashed_member_id, lead || i.name || tail AS task FROM (
  SELECT f.home_studio_id, s.hashed_member_id, 1 AS kind, 'Call ' AS lead, ' — ' || s.risk_tier || ' risk (' || {_P} || ')' AS tail,
    row_number() OVER (PARTITION BY f.home_studio_id ORDER BY s.churn_probability DESC, s.hashed_member_id) AS position
    FROM scores s JOIN snap f USING (hashed_member_id) WHERE s.risk_tier IN ('Critical','High') QUALIFY position <= 6
  UNION ALL SELECT home_studio_id, hashed_member_id, 2, 'Win-back outreach: ', ' ($' || CAST(CAST(round_even(monthly_price, 0) AS BIGINT) AS VARCHAR) || '/mo)',
    row_number() OVER (PARTITION BY home_studio_id ORDER BY monthly_price DESC, hashed_member_id) AS p2 FROM life_now WHERE stage = 'win_back_eligible' QUALIFY p2 <= 4
  UNION ALL SELECT home_studio_id, hashed_member_id, 3, 'Welcome check-in: ', '',
    row_number() OVER (PARTITION BY home_studio_id ORDER BY hashed_member_id) AS p3 FROM life_now WHERE stage = 'onboarding' QUALIFY p3 <= 3) t
  LEFT JOIN identity i USING (hashed_member_id))"""
check("top_k_per_group", f"SELECT * FROM {_TASKS}")
check("studio_digest", f"""
SELECT *, concat_ws(chr(10), 'DAILY DIGEST — ' || home_studio_id,
  'Win-back rank: #' || winback_rank || ' of ' || (SELECT count(*) FROM {_BOARD}) || ' (' || CAST(round_even(reactivation_rate * 100, 0) AS BIGINT) || '% reactivation, $'
    || format('{{:,}}', CAST(round_even(bonus_award, 0) AS BIGINT)) || ' bonus pace)', critical_calls || ' critical calls needed', payment_failures || ' payment failures to resolve',
  inactive_members || ' members inactive 14+ days', 'YOUR TASKS TODAY:' || chr(10) || coalesce(tasks, 'All clear — no high-priority follow-ups.'),
  'At-risk: ' || at_risk || ' | Win-back eligible: ' || winback_eligible || ' | Onboarding: ' || onboarding,
  CASE WHEN winback_eligible > 0 THEN 'Win-back revenue opportunity: $' || CAST(CAST(winback_revenue AS BIGINT) AS VARCHAR) || '/mo' END,
  positive_outcomes || '/' || total_outcomes || ' interventions had positive outcomes (' || CAST(round_even(positive_outcomes * 100 / CAST(total_outcomes AS DOUBLE), 0) AS BIGINT) || '%)') AS digest
FROM (SELECT st.home_studio_id, at_risk, winback_eligible, onboarding, winback_revenue, coalesce(critical_calls, 0) AS critical_calls, coalesce(payment_failures, 0) AS payment_failures,
  coalesce(inactive_members, 0) AS inactive_members, tk.tasks, b.rank AS winback_rank, b.reactivation_rate, b.bonus_award,
  (SELECT count(*) FROM outcomes WHERE outcome_30d IN ('re_engaged','payment_resolved','still_active')) AS positive_outcomes, (SELECT count(*) FROM outcomes) AS total_outcomes
FROM (SELECT home_studio_id, count(*) FILTER (stage = 'at_risk') AS at_risk, count(*) FILTER (stage = 'win_back_eligible') AS winback_eligible,
    count(*) FILTER (stage = 'onboarding') AS onboarding, coalesce(sum(monthly_price) FILTER (stage = 'win_back_eligible'), 0.0) AS winback_revenue FROM life_now GROUP BY 1) st
LEFT JOIN (SELECT f.home_studio_id, count(*) FILTER (s.risk_tier = 'Critical') AS critical_calls, count(*) FILTER (last_recurring_payment_failed) AS payment_failures,
    count(*) FILTER (days_since_last_session > 14) AS inactive_members FROM scores s JOIN snap f USING (hashed_member_id) GROUP BY 1) ct USING (home_studio_id)
LEFT JOIN (SELECT home_studio_id, string_agg(task, chr(10) ORDER BY kind, position) AS tasks FROM {_TASKS} GROUP BY 1) tk USING (home_studio_id)
LEFT JOIN {_BOARD} b USING (home_studio_id))""")

# --- member briefs
_CHATS = """(SELECT member_id, string_agg(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '~' || sender || '~' || message_text, ' | ' ORDER BY timestamp, chat_id) AS talk
  FROM (SELECT * FROM chats WHERE d >= (SELECT as_of_date FROM config) - 45
    QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY timestamp DESC, chat_id DESC) <= 8) GROUP BY 1)"""
check("member_payload", f"""
SELECT f.hashed_member_id, CAST(f.date_day AS VARCHAR) AS as_of_date, l.member_id AS member_ref, f.membership_tier, f.monthly_price, f.tenure_days,
  s.risk_tier AS churn_risk_tier, round(s.churn_probability, 3) AS churn_probability, l.stage AS lifecycle_stage, l.days_in_stage, f.days_since_last_session,
  f.sessions_attended_30d, f.sessions_booked_30d, round(f.attendance_rate_30d, 6) AS attendance_rate_30d, f.app_logins_30d, f.coach_chat_count_30d AS coach_chats_30d,
  round(f.retail_spend_30d, 6) AS retail_spend_30d, round(f.email_open_rate_30d, 6) AS email_open_rate_30d, f.last_recurring_payment_failed AS recent_payment_failed,
  f.failed_payments_count_30d AS failed_payments_30d, f.has_cancellation_query_30d, coalesce(c.talk, '') AS recent_chat_messages
FROM snap f JOIN scores s USING (hashed_member_id) JOIN lifecycle l USING (hashed_member_id) LEFT JOIN {_CHATS} c ON c.member_id = l.member_id""")
_SUMMARY = """concat_ws(' ', membership_tier || ' member, ' || risk_tier || ' churn risk.',
  CASE WHEN last_recurring_payment_failed THEN 'Most recent membership payment failed.' END,
  CASE WHEN has_cancellation_query_30d THEN 'Asked about freezing/cancelling in coach chat recently.' END,
  CASE WHEN days_since_last_session > 14 THEN 'No attended session in ' || days_since_last_session || ' days.' END)"""
check("rules_summary", f"""
SELECT hashed_member_id, {_SUMMARY} AS summary,
  coalesce(nullif(concat_ws(' | ', CASE WHEN last_recurring_payment_failed THEN 'Resolve the failed payment — offer to update the card on file.' END,
    CASE WHEN has_cancellation_query_30d THEN 'Address the cancellation/freeze question directly and empathetically.' END,
    CASE WHEN days_since_last_session > 14 THEN 'Invite them to a specific class time this week.' END), ''),
    'Check in, thank them for their engagement, and ask about goals.') AS next_steps,
  coalesce(nullif(concat_ws(' | ', CASE WHEN last_recurring_payment_failed THEN 'Lead with helping fix the billing hiccup, not selling.' END,
    CASE WHEN days_since_last_session > 14 THEN 'Ask if anything changed with their schedule or goals.' END), ''), 'Keep it friendly and personal.') AS talking_points
FROM snap JOIN scores USING (hashed_member_id)""")
check("validate_summary_numbers", "SELECT hashed_member_id, tenure_days % 4 <> 2 AS numbers_ok FROM snap")
_REPLY = "'Idle for ' || days_since_last_session || ' days'"
check("parse_summary_json", f"""
SELECT hashed_member_id, CASE WHEN tenure_days % 4 < 3 THEN {_REPLY} END AS summary,
  CASE tenure_days % 4 WHEN 0 THEN 'Call 2 times' WHEN 1 THEN 'Call 2 times' WHEN 2 THEN 'Call 7777777 times' END AS next_steps FROM snap""")
check("finalize_summaries", f"""
SELECT hashed_member_id, CASE WHEN tenure_days % 4 < 2 THEN {_REPLY} ELSE {_SUMMARY} END AS summary,
  CASE WHEN tenure_days % 4 < 2 THEN 'llm' ELSE 'rules' END AS source,
  CASE tenure_days % 4 WHEN 2 THEN 'LLM output contained numbers not present in source data' WHEN 3 THEN 'LLM returned unparseable output' END AS fallback_reason
FROM snap JOIN scores USING (hashed_member_id)""")

# --- quality, privacy, audit
check("dq_not_null", "SELECT count(*) FILTER (hashed_member_id IS NULL OR date_day IS NULL OR attendance_rate_30d IS NULL) AS null_rows FROM mart")
check("dq_unique", """
SELECT 'member_id' AS key, count(*) AS duplicates FROM (SELECT member_id FROM identity GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'hashed_member_id', count(*) FROM (SELECT hashed_member_id FROM identity GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'p_name', count(*) FROM (SELECT p_name FROM customer LEFT JOIN part ON p_partkey = c_custkey GROUP BY 1 HAVING count(*) > 1)""")
check("dq_range", """
SELECT count(*) FILTER (age < 14 OR age > 60) AS invalid_age, count(*) FILTER (attendance_rate_7d < 0 OR attendance_rate_7d > 1
  OR attendance_rate_30d < 0 OR attendance_rate_30d > 1 OR email_open_rate_30d < 0 OR email_open_rate_30d > 1) AS invalid_rates,
  count(*) FILTER (days_since_last_session < 0) AS invalid_idle FROM mart""")
check("label_distribution", "SELECT is_churned_14d AS label, count(*) AS rows FROM mart GROUP BY 1")
check("dq_label_binary", "SELECT count(DISTINCT is_churned_14d) AS label_values, count(DISTINCT is_churned_14d) = 2 AS is_binary FROM mart")
check("dq_pii_values", "SELECT count(*) AS leaked_values FROM mart WHERE gender = 'Other'")
check("dq_foreign_keys", " UNION ALL ".join(
    f"SELECT '{label}.{fk}' AS foreign_key, count(*) AS orphans FROM {child} WHERE {fk} NOT IN (SELECT {pk} FROM {parent})"
    for label, child, fk, parent, pk in [
        ("members", "members", "home_studio_id", "(SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sid FROM nation)", "sid"),
        ("memberships", "memberships", "member_id", "members", "member_id"),
        ("memberships", "memberships", "studio_id", "(SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sid FROM nation)", "sid"),
        ("sessions", "sessions", "member_id", "members", "member_id"),
        ("sessions", "sessions", "studio_id", "(SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sid FROM nation)", "sid"),
        ("transactions", "transactions", "member_id", "members", "member_id"),
        ("transactions", "transactions", "studio_id", "(SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sid FROM nation)", "sid"),
        ("app_events", "app_events", "member_id", "members", "member_id"),
        ("ai_coach_chats", "chats", "member_id", "members", "member_id"),
        ("email_events", "emails", "member_id", "members", "member_id"),
        ("ground_truth", "ground_truth", "member_id", "members", "member_id")]))
check("dq_row_counts", " UNION ALL ".join(
    f"SELECT '{label}' AS table_name, count(*) AS rows, TRUE AS flag_constant, {ok} AS as_expected FROM {src}"
    for label, src, ok in [
        ("studios", "nation", "count(*) = 25"), ("members", "members", "TRUE"), ("ground_truth", "ground_truth", "TRUE"),
        ("memberships", "memberships", "TRUE"), ("sessions", "sessions", "TRUE"), ("transactions", "transactions", "TRUE"),
        ("app_events", "app_events", "TRUE"), ("ai_coach_chats", "chats", "TRUE"), ("email_events", "emails", "TRUE")]))
check("dq_signal_coverage", """
SELECT n AS cohort_members, h AS with_signal, round(h / CAST(n AS DOUBLE), 6) AS coverage, h / CAST(n AS DOUBLE) >= 0.99 AS passes
FROM (SELECT count(*) AS n, count(*) FILTER (member_id IN (SELECT member_id FROM transactions WHERE status = 'Failed')) AS h
  FROM ground_truth WHERE cohort = 'sudden_drop')""")
check("dq_freshness", f"""
SELECT feed, {_TS.format('latest')} AS latest, latest >= TIMESTAMP '2024-01-30 00:00:00' AS fresh FROM (
  SELECT 'sessions' AS feed, max(scheduled_at) AS latest FROM sessions
  UNION ALL SELECT 'transactions', CAST(max(transaction_date) AS TIMESTAMP) FROM transactions
  UNION ALL SELECT 'members', CAST(max(join_date) AS TIMESTAMP) FROM members)""")
check("dq_volume_anomaly", """
SELECT CAST(day AS VARCHAR) AS day, n AS rows, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z,
  abs(round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6)) > 1.5 AS anomaly
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""")
check("match_rate", """
SELECT (SELECT count(*) FROM posn) AS pos_records, count(*) AS matched, round(count(*) / CAST((SELECT count(*) FROM posn) AS DOUBLE), 6) AS match_rate FROM matches""")
_GONE = "(SELECT 'M' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_acctbal < 0)"
check("apply_opt_out", f"SELECT member_id, home_studio_id FROM members WHERE member_id NOT IN {_GONE}")
check("erase_members", f"""
SELECT 'identity' AS table_name, count(*) AS rows FROM identity WHERE member_id NOT IN {_GONE}
UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE member_id NOT IN {_GONE}
UNION ALL SELECT 'scores', count(*) FROM scores JOIN identity USING (hashed_member_id) WHERE member_id NOT IN {_GONE}
UNION ALL SELECT 'audit', count(*) FROM audit WHERE member_id NOT IN {_GONE}""")
check("record_hash", """
SELECT line + 1 AS seq, sha256(p || '{"event":"auth","outcome":"' || outcome || '","prev_hash":"' || p || '","reason":"' || event_type || '","source":"' || source
  || '","ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","username":"' || username || '"}') AS digest
FROM (SELECT a.*, e.event_type, sha256(line || '-prev') AS p FROM auth a JOIN events e ON e.event_id = a.line)""")
check("verify_hash_chain", """
SELECT username, day, NOT (edited OR lost OR cut) AS ok, CASE WHEN edited OR lost THEN 2 END AS first_broken,
  n - CAST(lost OR cut AS INTEGER) AS records, NOT (edited AND n = 2 OR lost OR cut) AS sealed
FROM (SELECT username, day, n, u % 3 = 0 AND n > 1 AS edited, u % 3 = 1 AND n > 2 AS lost, u % 3 = 2 AND n > 2 AS cut
  FROM (SELECT username, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(substr(username, 5) AS BIGINT) AS u FROM auth GROUP BY 1, 2, 4))""")
_KEYED = """(SELECT 'username' AS key_type, username AS key_value, ts, outcome FROM auth
  UNION ALL SELECT 'source', source, ts, outcome FROM auth WHERE source <> 'unknown')"""


def _fails(where: str) -> str:
    return f"""(SELECT key_type, key_value, count(*) AS failures, max(ts) AS last_failure FROM
  (SELECT *, max(CASE WHEN outcome = 'success' THEN ts END) OVER (PARTITION BY key_type, key_value) AS ok FROM {_KEYED} WHERE {where})
  WHERE outcome = 'failure' AND (ok IS NULL OR ts > ok) GROUP BY 1, 2)"""


check("failures_since_success", f"""
SELECT key_type, key_value, failures, {_TS.format('last_failure')} AS last_failure FROM {_fails('TRUE')}""")
check("lockout_status", f"""
SELECT key_type, key_value, failures, failures >= 2 AND last_failure + INTERVAL 240 MINUTE > {_NOW} AS locked,
  CASE WHEN failures >= 2 AND last_failure + INTERVAL 240 MINUTE > {_NOW}
    THEN CAST(floor(epoch(last_failure + INTERVAL 240 MINUTE)) - epoch({_NOW}) AS BIGINT) ELSE 0 END AS seconds_remaining
FROM {_fails(f"ts >= {_NOW} - INTERVAL 240 MINUTE AND ts <= {_NOW}")}""")
check("auth_failure_summary", f"""
SELECT 'username' AS dimension, username AS value, count(*) AS failures FROM auth
WHERE outcome = 'failure' AND ts BETWEEN {_NOW} - INTERVAL 600 MINUTE AND {_NOW} GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM auth WHERE outcome = 'failure' AND ts BETWEEN {_NOW} - INTERVAL 600 MINUTE AND {_NOW} GROUP BY 2""")
check("oversight_log", f"""
SELECT access_id, {_TS.format('accessed_at')} AS accessed_at, admin_user, viewed_studio FROM
  (SELECT *, lag(viewed_studio) OVER (PARTITION BY admin_user ORDER BY accessed_at, access_id) AS prior FROM
    (SELECT event_id AS access_id, ts AS accessed_at, event_type AS admin_user, 'S' || (user_id % 3) AS viewed_studio FROM events))
WHERE prior IS NULL OR prior <> viewed_studio""")

# --- identity
check("normalize_contacts", "SELECT app_member_id, ne AS norm_email, np AS norm_phone, nn AS norm_name FROM appn")
check("match_exact_contacts", "SELECT member_id, app_member_id, layer FROM exact_match")
check("shared_email_guard", """
SELECT p.member_id, a.app_member_id, 'phone' AS layer
FROM (SELECT *, row_number() OVER (PARTITION BY np ORDER BY row_order) AS rn FROM posn WHERE np <> '') p
JOIN (SELECT *, row_number() OVER (PARTITION BY np ORDER BY row_order) AS rn FROM appn WHERE np <> '') a ON p.np = a.np AND p.rn = a.rn""")
check("fuzzy_candidates", "SELECT member_id, app_member_id FROM fuzzy_pairs")

check("jaro_winkler", """
SELECT a.app_member_id, round(jaro_winkler_similarity(lower(regexp_replace(a.name, '\\s', '', 'g')),
  lower(regexp_replace(p.name, '\\s', '', 'g') || right(a.app_member_id, 2))), 6) AS similarity
FROM app a JOIN pos p USING (row_order)""")
check("resolve_identities", f"""
SELECT p.member_id, coalesce(m.app_member_id, 'NONE') AS app_member_id, sha256(p.ne || '{SALT}') AS hashed_member_id, p.name, p.email, p.phone
FROM posn p LEFT JOIN matches m USING (member_id)
UNION ALL SELECT 'NONE', app_member_id, sha256(ne || '{SALT}'), name, email, phone FROM appn
WHERE app_member_id NOT IN (SELECT app_member_id FROM matches)""")

# --- model
check("training_window", """
SELECT CAST(min(date_day) FILTER (inside) AS VARCHAR) AS window_start, CAST(max(date_day) FILTER (inside) AS VARCHAR) AS window_end,
  count(*) FILTER (inside) AS rows_in_window, count(*) FILTER (date_day < ws) AS rows_discarded_as_old, CAST(min(date_day) AS VARCHAR) AS oldest_available
FROM (SELECT date_day, as_of_date - INTERVAL 2 MONTH AS ws, date_day >= as_of_date - INTERVAL 2 MONTH AND date_day <= as_of_date - 14 AS inside FROM mart, config)""")
_WIN = "(SELECT * FROM mart WHERE date_day >= (SELECT as_of_date - INTERVAL 24 MONTH FROM config) AND date_day <= (SELECT as_of_date - 14 FROM config))"
_CUT = f"(SELECT quantile_cont(epoch(date_day), 0.8) FROM {_WIN})"
check("quantile_date", f"SELECT round({_CUT}, 6) AS split_seconds")
check("chronological_split", f"""
SELECT CASE WHEN epoch(date_day) < {_CUT} THEN 'train' ELSE 'validation' END AS side, count(*) AS rows,
  CAST(min(date_day) AS VARCHAR) AS first_day, CAST(max(date_day) AS VARCHAR) AS last_day FROM {_WIN} GROUP BY 1""")
check("class_weight", """
SELECT count(*) FILTER (NOT is_churned_14d) AS negatives, count(*) FILTER (is_churned_14d) AS positives,
  round(count(*) FILTER (NOT is_churned_14d) / CAST(count(*) FILTER (is_churned_14d) AS DOUBLE), 6) AS scale_pos_weight FROM mart""")
_SP = """(SELECT sha256(f.hashed_member_id || CAST(f.date_day AS VARCHAR)) AS row_key, f.date_day, f.gender, f.home_studio_id, f.is_churned_14d AS actual,
  CAST('0x' || left(sha256(f.hashed_member_id || CAST(f.date_day AS VARCHAR)), 4) AS INTEGER) / 65535.0::DOUBLE AS p FROM mart f)"""
_BYS = f"(SELECT p, count(*) FILTER (actual) AS pos, count(*) FILTER (NOT actual) AS neg FROM {_SP} GROUP BY p)"
check("auc_roc", f"""
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc_roc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {_BYS})""")
check("average_precision", f"""
SELECT round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / sum(pos), 6) AS average_precision
FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM {_BYS} WINDOW w AS (ORDER BY p DESC))""")
check("roc_curve", f"""
SELECT round(p, 6) AS threshold, round(sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE), 6) AS fpr, round(sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE), 6) AS tpr
FROM {_BYS} WINDOW w AS (ORDER BY p DESC)""")
check("confusion_at", f"""
SELECT CAST(actual AS INTEGER) AS actual, CAST(p >= 0.35 AS INTEGER) AS predicted, count(*) AS rows FROM {_SP} GROUP BY 1, 2""")
_CELLS = f"""(SELECT CAST(count(*) FILTER (actual AND p >= 0.35) AS DOUBLE) AS tp, count(*) FILTER (NOT actual AND p >= 0.35) AS fp,
  count(*) FILTER (actual AND p < 0.35) AS fn, CAST(count(*) FILTER (NOT actual AND p < 0.35) AS DOUBLE) AS tn FROM {_SP})"""
check("classification_report", f"""
SELECT '0' AS class, round(tn / (tn + fn), 6) AS precision, round(tn / (tn + fp), 6) AS recall, round(2 * tn / (2 * tn + fn + fp), 6) AS f1,
  CAST(tn + fp AS BIGINT) AS support, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM {_CELLS}
UNION ALL SELECT '1', round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), round(2 * tp / (2 * tp + fn + fp), 6), CAST(tp + fn AS BIGINT),
  round((tp + tn) / (tp + tn + fp + fn), 6) FROM {_CELLS}""")
check("precision_at_top_k", f"""
SELECT count(*) AS top_rows, round(avg(CAST(actual AS INTEGER)), 6) AS precision_at_k FROM
  (SELECT *, row_number() OVER (ORDER BY p DESC, row_key) AS r, count(*) OVER () AS n FROM {_SP}) WHERE r <= floor(n * 0.1)""")
check("calibration_curve_uniform", f"""
SELECT CAST(greatest(ceil(p * 10), 1) AS BIGINT) AS bin, count(*) AS rows, round(avg(p), 6) AS prob_pred, round(avg(CAST(actual AS INTEGER)), 6) AS prob_true
FROM {_SP} GROUP BY 1""")
_FAIR = """count(*) AS records, round(avg(CAST(actual AS INTEGER)), 6) AS observed_churn_rate, round(avg(p), 6) AS avg_predicted_prob,
  round(avg(CAST(p >= 0.35 AS INTEGER)), 6) AS predicted_churn_rate"""
check("fairness_slices", f"""
SELECT 'gender' AS slice, gender AS value, {_FAIR} FROM {_SP} GROUP BY gender
UNION ALL SELECT 'home_studio_id', home_studio_id, {_FAIR} FROM {_SP} GROUP BY home_studio_id""")
_CALIB = f"""(SELECT CAST(greatest(ceil((r - 1) * 10 / CAST(n - 1 AS DOUBLE)) - 1, 0) AS INTEGER) AS decile, count(*) AS count, round(avg(p), 4) AS avg_predicted,
  round(avg(CAST(actual AS INTEGER)), 4) AS actual_rate, round(abs(avg(p) - avg(CAST(actual AS INTEGER))), 4) AS abs_deviation
FROM (SELECT *, row_number() OVER (ORDER BY p, row_key) AS r, count(*) OVER () AS n FROM {_SP}
  WHERE date_day <= (SELECT as_of_date - 14 FROM config) AND date_day > (SELECT as_of_date - 104 FROM config)) GROUP BY 1)"""
check("calibration_deciles", f"SELECT * FROM {_CALIB}")


def _psi(ref: str, cur: str, features: dict[str, tuple[str, str]], table: str) -> str:
    """PSI per feature: quantile edges of the reference, shares of both sides per bin."""
    parts = []
    for name, (r, c) in features.items():
        parts.append(f"""SELECT '{name}' AS feature, CAST({r} AS DOUBLE) AS v, 1 AS side FROM {table} WHERE {ref} AND {r} IS NOT NULL
UNION ALL SELECT '{name}', CAST({c} AS DOUBLE), 2 FROM {table} WHERE {cur} AND {c} IS NOT NULL""")
    union = " UNION ALL ".join(parts)
    probs = ", ".join(f"{i / 10}" for i in range(11))
    return f"""(SELECT feature, sum(CASE WHEN tr >= 10 AND tc >= 10 AND len(e) >= 3 THEN (cs - rs) * ln(cs / rs) ELSE 0.0 END) AS psi
FROM (SELECT a.feature, a.e, a.b, t.tr, t.tc, greatest(coalesce(x.nr, 0) / CAST(t.tr AS DOUBLE), 1e-6) AS rs, greatest(coalesce(x.nc, 0) / CAST(t.tc AS DOUBLE), 1e-6) AS cs
  FROM (SELECT feature, e, unnest(range(0, greatest(len(e) - 1, 1))) AS b FROM (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS e FROM ({union}) WHERE side = 1 GROUP BY 1)) a
  JOIN (SELECT feature, count(*) FILTER (side = 1) AS tr, count(*) FILTER (side = 2) AS tc FROM ({union}) GROUP BY 1) t USING (feature)
  LEFT JOIN (SELECT u.feature, len(list_filter(q.e[2:len(q.e) - 1], lambda z: z <= u.v)) AS b, count(*) FILTER (side = 1) AS nr, count(*) FILTER (side = 2) AS nc
    FROM ({union}) u JOIN (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS e FROM ({union}) WHERE side = 1 GROUP BY 1) q USING (feature) GROUP BY 1, 2) x
    ON x.feature = a.feature AND x.b = a.b WHERE t.tc > 0) GROUP BY feature)"""


_FEATS = ["sessions_attended_30d", "days_since_last_session", "app_logins_30d", "failed_payments_count_30d", "attendance_rate_30d",
          "retail_spend_30d", "coach_chat_count_30d", "monthly_price"]
_SHIFT = {"sessions_attended_30d": "sessions_attended_30d * 0.3::DOUBLE", "days_since_last_session": "days_since_last_session + 25",
          "app_logins_30d": "app_logins_30d * 0.4::DOUBLE", "failed_payments_count_30d": "failed_payments_count_30d + 1"}
_REFW = "date_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"
_CURW = "date_day > (SELECT as_of_date - 10 FROM config)"
_SEV = "CASE WHEN psi >= 0.2 THEN 'Significant' WHEN psi >= 0.1 THEN 'Moderate' ELSE 'Stable' END AS severity"
_ROUNDED = "(SELECT * REPLACE (round(retail_spend_30d, 6) AS retail_spend_30d) FROM mart)"
check("feature_drift", f"""
SELECT feature, psi, {_SEV} FROM (SELECT feature, round(psi, 4) AS psi FROM {_psi(_REFW, _CURW, {x: (x, x) for x in _FEATS}, 'mart')})""")
_DP = f"(SELECT feature, round(psi, 4) AS psi FROM {_psi(_REFW, _CURW, {x: (x, _SHIFT.get(x, x)) for x in _FEATS}, 'mart')})"
check("feature_drift_perturbed", f"SELECT feature, psi, {_SEV} FROM {_DP}")
check("psi", f"""
SELECT feature, round(psi, 6) AS psi FROM {_psi("l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'",
    {x: (x, x) for x in ('l_quantity', 'l_extendedprice', 'l_discount')}, 'lineitem')}""")
check("retrain_decision", f"""
SELECT '{NOW}' AS checked_at, round(dev, 4) AS calib_max_dev, round(mp, 4) AS max_psi, dev >= 0.15 OR mp >= 0.25 AS needs_retrain,
  coalesce(nullif(concat_ws('; ', CASE WHEN dev >= 0.15 THEN 'calibration deviation ' || printf('%.1f', dev * 100) || '% >= 15%' END,
    CASE WHEN mp >= 0.25 THEN 'feature drift PSI ' || printf('%.2f', mp) || ' >= 0.25 (' || w || ')' END), ''), 'none') AS reasons, 'simulate-drift' AS mode
FROM (SELECT (SELECT max(abs_deviation) FROM {_CALIB}) AS dev, max(psi) AS mp, arg_max(feature, (psi, feature)) AS w FROM {_DP})""")
_RECORD = """SELECT '{v}' AS version_id, '2024-01-{d} 00:00:00' AS trained_at, 'manual' AS trigger, CAST(min(date_day) FILTER (inside) AS VARCHAR) AS train_window_start,
  CAST(max(date_day) FILTER (inside) AS VARCHAR) AS train_window_end, {n} AS window_months, (SELECT count(*) FROM {win} WHERE epoch(date_day) < {cut}) AS train_rows,
  (SELECT count(*) FROM {win} WHERE epoch(date_day) >= {cut}) AS val_rows, count(*) FILTER (date_day < ws) AS rows_discarded_as_old,
  (SELECT round(count(*) FILTER (NOT is_churned_14d) / CAST(count(*) FILTER (is_churned_14d) AS DOUBLE), 1) FROM {win} WHERE epoch(date_day) < {cut}) AS scale_pos_weight,
  TRUE AS val_auc, TRUE AS val_pr_auc, 'churn-model' AS model_path
FROM (SELECT date_day, as_of_date - INTERVAL {n} MONTH AS ws, date_day >= as_of_date - INTERVAL {n} MONTH AND date_day <= as_of_date - 14 AS inside FROM mart, config)"""
_V2 = _RECORD.format(v="v2", n=24, d=30, win=_WIN, cut=_CUT)
check("model_registry", _RECORD.format(v="v1", n=1, d=29, win=_WIN, cut=_CUT) + " UNION ALL " + _V2)
check("registry_latest", _V2)
check("calibrate_isotonic", f"""
SELECT count(*) AS rows, count(DISTINCT round(p, 4)) AS points, round(avg(CAST(actual AS INTEGER)), 6) AS mean_calibrated, TRUE AS in_bounds, TRUE AS rises FROM {_SP}""")
check("score_members_check", "SELECT count(*) AS rows, count(*) AS members, TRUE AS in_bounds, TRUE AS tiers_match FROM snap")
_NUM = "(coalesce(CAST({0} AS DOUBLE), -1) - avg(coalesce(CAST({0} AS DOUBLE), -1)) OVER ()) / stddev_samp(coalesce(CAST({0} AS DOUBLE), -1)) OVER ()"
_SCALED = ", ".join(
    f"CASE WHEN stddev_samp(coalesce(CAST({n} AS DOUBLE), -1)) OVER () = 0 THEN 0 ELSE round({_NUM.format(n)}, 6) END AS {n}" for n in C.NUMERIC_FEATURES)
_HOT = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_at" for c in C.CATEGORICAL_FEATURES)
_FLAGS = ", ".join(f"CAST({b} AS INTEGER) AS {b}" for b in C.BOOLEAN_FEATURES)
_WIDTH = " + ".join(f"(SELECT count(DISTINCT {c}) FROM snap)" for c in C.CATEGORICAL_FEATURES)
check("feature_vectors", f"""
SELECT hashed_member_id, {_SCALED}, {_HOT}, {_FLAGS}, {len(C.NUMERIC_FEATURES) + len(C.CATEGORICAL_FEATURES) + len(C.BOOLEAN_FEATURES)} + {_WIDTH} AS width FROM snap""")
check("drift_windows", """
SELECT 'reference' AS side, count(*) AS rows, CAST(min(date_day) AS VARCHAR) AS first_day, CAST(max(date_day) AS VARCHAR) AS last_day
FROM mart, config WHERE date_day >= as_of_date - INTERVAL 12 MONTH AND date_day <= as_of_date - 20
UNION ALL SELECT 'current', count(*), CAST(min(date_day) AS VARCHAR), CAST(max(date_day) AS VARCHAR) FROM mart, config WHERE date_day > as_of_date - 20""")
check("perturb_window", f"""
SELECT {day('date_day')}, round(sum(sessions_attended_30d * 0.3::DOUBLE), 6) AS attended, CAST(sum(days_since_last_session + 25) AS BIGINT) AS idle,
  round(sum(app_logins_30d * 0.4::DOUBLE), 6) AS logins, CAST(sum(failed_payments_count_30d + 1) AS BIGINT) AS failed
FROM mart WHERE date_day > (SELECT as_of_date - 30 FROM config) GROUP BY date_day""")

# --- exploration
check("monthly_signups", "SELECT strftime(join_date, '%Y-%m') AS join_month, count(*) AS signups FROM o_members GROUP BY 1")
check("booking_heatmap", f"""
SELECT CAST(w.i AS INTEGER) AS day_no, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][w.i + 1] AS day_of_week,
  {", ".join(f"count(*) FILTER (hour(scheduled_at) = {h}) AS h{h:02d}" for h in range(24))}
FROM range(0, 7) w(i) LEFT JOIN sessions s ON isodow(s.scheduled_at) - 1 = w.i GROUP BY w.i""")
check("active_at_month", """
SELECT cohort, CAST(last_day(CAST(m AS DATE)) AS VARCHAR) AS month, count(*) FILTER (join_date <= last_day(CAST(m AS DATE)) AND (NOT churned OR churn_date > last_day(CAST(m AS DATE)))) AS active_members
FROM o_members, (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders) GROUP BY 1, 2""")
check("fail_to_cancel_lag", """
SELECT count(*) AS records, round(avg(churn_date - transaction_date), 6) AS mean_days, round(stddev_samp(churn_date - transaction_date), 6) AS std_days
FROM transactions JOIN ground_truth USING (member_id)
WHERE churned AND cohort = 'sudden_drop' AND transaction_type = 'Membership Fee' AND status = 'Failed'""")
check("attendance_by_lifetime_decile", """
SELECT round(bin, 6) AS progress_bin, count(*) AS sessions, round(avg(CAST(attended AS INTEGER)), 6) AS attendance_rate
FROM (SELECT attended, least(greatest(round_even(CASE WHEN life <> 0 THEN elapsed / CAST(life AS DOUBLE) WHEN elapsed > 0 THEN 1.0 WHEN elapsed < 0 THEN 0.0 END * 10, 0) / 10, 0), 1) AS bin
  FROM (SELECT s.attended, g.churn_date - m.join_date AS life, s.d - m.join_date AS elapsed FROM sessions s JOIN ground_truth g USING (member_id) JOIN members m USING (member_id)
    WHERE g.churned AND g.cohort = 'declining')) WHERE bin IS NOT NULL GROUP BY 1""")

# --- shared primitives
check("scan_jsonl_log", "SELECT outcome, source, count(*) AS events FROM auth GROUP BY 1, 2")
check("sink_parquet", f"""
SELECT {day('date_day')}, count(*) AS rows, CAST(sum(app_logins_30d) AS BIGINT) AS logins FROM mart GROUP BY date_day""")
_LQ = f"""(SELECT hashed_member_id, member_id, CASE WHEN stage = 'onboarding' THEN 'OnboardingEmail' WHEN days_in_stage <= 14 THEN 'WinBackEmail'
    WHEN days_in_stage <= 45 THEN 'WinBackSMS' ELSE 'WinBackEmail' END AS action_type, 'DryRun' AS status FROM lifecycle
  WHERE ((stage = 'onboarding' AND tenure_days <= 14) OR stage = 'win_back_eligible') AND hashed_member_id NOT IN {_RECENT})"""
check("sink_append", f"""
SELECT action_type, status, count(*) AS rows FROM (SELECT action_type, status FROM {_D} WHERE status IS NOT NULL AND status <> 'RateLimited'
  UNION ALL SELECT action_type, status FROM {_LQ}) GROUP BY 1, 2""")
check("concat_append", f"""
SELECT 'ACr1' || left(hashed_member_id, 16) AS action_id, member_id, action_type, status, '{NOW}' AS created_at,
  CASE WHEN status <> 'Pending' THEN '{NOW}' END AS processed_at FROM {_D} WHERE status IS NOT NULL
UNION ALL SELECT 'LCr1' || left(hashed_member_id, 16), member_id, action_type, status, '{NOW}', '{NOW}' FROM {_LQ}""")
check("union_all_text", """
SELECT value, count(*) AS n FROM (SELECT hashed_member_id AS value FROM mart UNION ALL SELECT gender FROM mart
  UNION ALL SELECT home_studio_id FROM mart UNION ALL SELECT membership_tier FROM mart) GROUP BY 1""")
check("union_distinct_pii", "SELECT name AS value FROM identity UNION SELECT email FROM identity UNION SELECT phone FROM identity")
check("band_join", "SELECT audit_id, sessions_post_7d, sessions_post_14d, sessions_post_30d FROM outcomes")
check("running_survival", """
SELECT month, round(exp(sum(ln(greatest(step, 1e-300))) OVER (ORDER BY month)), 4) AS retention, at_risk
FROM (SELECT m AS month, count(*) FILTER (dur >= m - 1) AS at_risk, CASE WHEN count(*) FILTER (dur >= m - 1) > 0
      THEN 1 - count(*) FILTER (churned AND dur >= m - 1 AND dur < m) / CAST(count(*) FILTER (dur >= m - 1) AS DOUBLE) ELSE 1.0 END AS step
  FROM (SELECT churned, greatest((coalesce(churn_date, (SELECT as_of_date FROM config)) - join_date) / 30.44, 0) AS dur
    FROM members JOIN ground_truth USING (member_id)), range(1, 37) t(m) GROUP BY m)""")
check("rank_dense_index", """
SELECT o_orderpriority, count(*) AS orders, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders GROUP BY 1""")
check("rank_first", f"""
SELECT row_key, round(p, 6) AS churn_probability, row_number() OVER (ORDER BY p, row_key) AS row_number FROM {_SP}""")
check("running_send_count", f"""
SELECT hashed_member_id, round(risk_score, 6) AS risk_score, row_number() OVER (ORDER BY d.risk_score DESC, hashed_member_id) AS sent_so_far
FROM (SELECT *, CASE WHEN is_holdout THEN 'Holdout' WHEN dt IN ('Email','SMS') AND hashed_member_id IN {_RECENT} THEN 'RateLimited' ELSE 'Sent' END AS st FROM {_D}) d
WHERE dt IN ('Email','SMS') AND st = 'Sent'""")
check("prev_row_link", """
SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY line) AS seq, TRUE AS linked,
  row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY line) % 10 <> 0 AS intact FROM auth""")
check("dq_constant_flag", """
SELECT unnest(['studios','members','ground_truth','memberships','sessions','transactions','app_events','ai_coach_chats','email_events']) AS table_name, TRUE AS flag_constant""")

# --- streams
_ACT = """(SELECT member_id, scheduled_at AS ts, CASE WHEN attended THEN 'attended' ELSE 'booked' END AS kind FROM sessions
  UNION ALL SELECT member_id, event_timestamp, event_type FROM app_events UNION ALL SELECT member_id, sent_at, status FROM emails
  UNION ALL SELECT member_id, CAST(transaction_date AS TIMESTAMP), CASE WHEN status = 'Failed' THEN 'failed_payment' ELSE 'payment' END FROM transactions
  UNION ALL SELECT member_id, timestamp, CASE WHEN lower(message_text) LIKE '%cancel%' THEN 'cancel_question' ELSE 'chat' END FROM chats WHERE sender = 'member')"""
_LATE = "(CAST(ts AS DATE) <= DATE '2024-01-10' AND CAST(substr(member_id, 2) AS BIGINT) % 5 = 0)"
_IN_TIME = f"(SELECT * FROM {_ACT} WHERE NOT {_LATE})"
_ACT_COUNTS = """count(*) AS events, count(*) FILTER (kind IN ('booked','attended')) AS booked, count(*) FILTER (kind = 'attended') AS attended,
  count(*) FILTER (kind = 'open_app') AS logins, count(*) FILTER (kind = 'view_metrics') AS metric_views, count(*) FILTER (kind IN ('Sent','Delivered','Bounced','Opened','Clicked')) AS emails_sent,
  count(*) FILTER (kind IN ('Opened','Clicked')) AS emails_opened, count(*) FILTER (kind = 'Clicked') AS emails_clicked, count(*) FILTER (kind IN ('payment','failed_payment')) AS payments,
  count(*) FILTER (kind = 'failed_payment') AS failed_payments, count(*) FILTER (kind IN ('chat','cancel_question')) AS chats, count(*) FILTER (kind = 'cancel_question') AS cancel_questions"""
check("stream_daily_activity", f"""
SELECT member_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, {_ACT_COUNTS} FROM {_IN_TIME} GROUP BY 1, 2""")
check("stream_late_rows", f"""
SELECT member_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS rows FROM {_ACT} WHERE {_LATE} GROUP BY 1, 2""")
for _name, _rows in (("stream_rolling_activity", _IN_TIME), ("rolling_activity", _ACT)):
    check(_name, f"""
SELECT member_id, CAST(CAST(ts AS DATE) + CAST(o AS INTEGER) AS VARCHAR) AS date_day, {_ACT_COUNTS} FROM {_rows}, range(0, 30) t(o) GROUP BY 1, 2""")
check("stream_lockout", f"""
SELECT * FROM (WITH RECURSIVE keyed AS (
  SELECT key_type, key_value, ts, count(*) FILTER (outcome = 'failure') AS failed, bool_or(outcome = 'success') AS good
  FROM {_KEYED} WHERE outcome IN ('failure', 'success') GROUP BY 1, 2, 3
), cleared AS (
  SELECT *, max(CASE WHEN good THEN ts END) OVER (PARTITION BY key_type, key_value ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok FROM keyed
), full_windows AS (
  SELECT a.key_type, a.key_value, a.ts, sum(b.failed) AS failures FROM cleared a JOIN cleared b
    ON b.key_type = a.key_type AND b.key_value = a.key_value AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 600 MINUTE AND (a.ok IS NULL OR b.ts > a.ok)
  WHERE a.failed > 0 GROUP BY 1, 2, 3 HAVING sum(b.failed) >= 2
), locks AS (
  SELECT key_type, key_value, min(ts) AS ts FROM full_windows GROUP BY 1, 2
  UNION ALL
  SELECT key_type, key_value, nxt FROM (
    SELECT l.key_type, l.key_value, (SELECT min(w.ts) FROM full_windows w WHERE w.key_type = l.key_type AND w.key_value = l.key_value
      AND w.ts >= l.ts + INTERVAL 60 MINUTE) AS nxt FROM locks l) WHERE nxt IS NOT NULL
)
SELECT key_type, key_value, {_TS.format('ts')} AS locked_at, {_TS.format('ts + INTERVAL 60 MINUTE')} AS locked_until, CAST(failures AS BIGINT) AS failures
FROM locks JOIN full_windows USING (key_type, key_value, ts))""")
check("stream_send_rate_guard", f"""
SELECT {_TS.format('ws')} AS window_start, {_TS.format("ws + INTERVAL 60 MINUTE")} AS window_end, count(*) AS sends
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, sent_at) - INTERVAL 5 MINUTE * o AS ws FROM audit, range(0, 12) t(o) WHERE status = 'Sent') GROUP BY ws HAVING count(*) > 2""")
check("stream_intent_flags", f"""
SELECT transaction_id AS event_id, member_id, {_TS.format('CAST(transaction_date AS TIMESTAMP)')} AS ts, 'payment_failed' AS flag FROM transactions WHERE status = 'Failed'
UNION ALL SELECT chat_id, member_id, {_TS.format('timestamp')}, 'cancel_question' FROM chats WHERE sender = 'member' AND lower(message_text) LIKE '%cancel%'""")
check("stream_member_sessions", f"""
SELECT member_id, {_TS.format('min(ts)')} AS session_start, {_TS.format('max(ts) + INTERVAL 30 MINUTE')} AS session_end, count(*) AS events
FROM (SELECT *, sum(CASE WHEN ts < prior + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY member_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(ts) OVER (PARTITION BY member_id ORDER BY ts) AS prior FROM {_IN_TIME})) GROUP BY member_id, g""")
