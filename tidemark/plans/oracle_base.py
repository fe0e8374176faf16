"""SQL definitions of the bound tables, shared by the check queries.

Each block is one CTE. ``with_blocks`` collects the blocks a query needs.
"""

from __future__ import annotations

import re

from tidemark.sources.bindings import HOLDOUT_SALT, SALT

BLOCKS: dict[str, str] = {}


def _block(name: str, sql: str) -> None:
    BLOCKS[name] = sql.strip()


_block("cust", """
SELECT *, c_custkey AS k,
  CASE WHEN c_custkey % 25 = 0 THEN DATE '2023-08-01'
       ELSE DATE '2023-11-01' + CAST(c_custkey * 7 % 80 AS INTEGER) END AS jd,
  CASE WHEN c_mktsegment IN ('BUILDING','AUTOMOBILE') THEN 'Basic'
       WHEN c_mktsegment IN ('MACHINERY','HOUSEHOLD') THEN 'VIP' ELSE 'Premium' END AS mtier
FROM customer""")
_block("members", """
SELECT 'M' || lpad(CAST(k AS VARCHAR), 10, '0') AS member_id, c_name AS name,
  lower(replace(c_name, '#', '.')) || '@example.test' AS email,
  '555-' || lpad(CAST(k % 900 + 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS phone,
  CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Other' END AS gender,
  DATE '1960-01-01' + CAST(k * 37 % 14000 AS INTEGER) AS dob,
  'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS home_studio_id, jd AS join_date
FROM cust""")
_block("ground_truth", """
SELECT 'M' || lpad(CAST(k AS VARCHAR), 10, '0') AS member_id,
  CASE k % 3 WHEN 0 THEN 'steady' WHEN 1 THEN 'declining' ELSE 'sudden_drop' END AS cohort,
  k % 5 = 0 AS churned,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 25 = 0 THEN DATE '2023-10-15'
       ELSE greatest(jd + 10, DATE '2024-01-01' + CAST(k % 28 AS INTEGER)) END END AS churn_date
FROM cust""")
_block("memberships", """
SELECT 'MB' || lpad(CAST(k AS VARCHAR), 10, '0') AS membership_id,
  'M' || lpad(CAST(k AS VARCHAR), 10, '0') AS member_id,
  'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS studio_id, mtier AS membership_tier,
  CASE mtier WHEN 'Basic' THEN 59.0::DOUBLE WHEN 'VIP' THEN 99.0::DOUBLE ELSE 129.0::DOUBLE END AS monthly_price
FROM cust""")
_block("ev", """
SELECT *, event_id AS e, 'M' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS member_id,
  'S' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS studio_id, CAST(ts AS DATE) AS d
FROM events""")
_block("sessions", """
SELECT 'SE' || e AS session_id, member_id, studio_id, ts AS scheduled_at, d, e % 10 <> 0 AS attended,
  CAST(120 + e % 11 AS DOUBLE) AS sauna_temp_f FROM ev WHERE event_type = 'view'""")
_block("transactions", """
SELECT 'TX' || e AS transaction_id, member_id, studio_id, d AS transaction_date, value AS amount,
  CASE WHEN e % 3 = 0 THEN 'Membership Fee' ELSE 'Retail - Item' END AS transaction_type,
  CASE WHEN e % 7 = 0 THEN 'Failed' ELSE 'Paid' END AS status
FROM ev WHERE event_type = 'purchase'""")
_block("app_events", """
SELECT 'EV' || e AS event_id, member_id, CASE WHEN e % 4 = 0 THEN 'view_metrics' ELSE 'open_app' END AS event_type,
  ts AS event_timestamp, d FROM ev WHERE event_type = 'click'""")
_block("chats", """
SELECT 'CH' || e AS chat_id, member_id, ts AS timestamp, d, CASE WHEN e % 2 = 0 THEN 'member' ELSE 'coach' END AS sender,
  CASE WHEN e % 5 = 0 THEN 'How do I CANCEL my plan?' ELSE 'Thanks' END AS message_text
FROM ev WHERE event_type = 'error'""")
_block("emails", """
SELECT 'EM' || e AS email_id, member_id, ts AS sent_at, d,
  CASE e % 3 WHEN 0 THEN 'Sent' WHEN 1 THEN 'Opened' ELSE 'Clicked' END AS status
FROM ev WHERE event_type = 'signup'""")
_block("identity", f"""
SELECT member_id, sha256(concat(email, '{SALT}')) AS hashed_member_id, name, email, phone FROM members""")
_block("config", """
SELECT greatest(
  (SELECT max(d) FROM sessions), (SELECT max(d) FROM app_events),
  (SELECT max(transaction_date) FROM transactions), (SELECT max(d) FROM emails),
  (SELECT max(churn_date) FROM ground_truth)) AS as_of_date""")
_block("daily_sessions", """
SELECT member_id, d AS event_date, count(*) AS booked_count,
  CAST(sum(CASE WHEN attended THEN 1 ELSE 0 END) AS BIGINT) AS attended_count,
  sum(CASE WHEN attended THEN sauna_temp_f ELSE 0.0 END) AS temp_sum,
  CAST(sum(CASE WHEN attended THEN 1 ELSE 0 END) AS BIGINT) AS temp_count
FROM sessions GROUP BY ALL""")
_block("daily_transactions", """
SELECT member_id, transaction_date AS event_date,
  sum(CASE WHEN transaction_type LIKE 'Retail%' AND status = 'Paid' THEN amount ELSE 0.0 END) AS retail_spend,
  CAST(sum(CASE WHEN transaction_type = 'Membership Fee' AND status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS membership_failed_count,
  max(CASE WHEN transaction_type = 'Membership Fee' THEN status END) AS membership_status
FROM transactions GROUP BY ALL""")
_block("daily_app_events", """
SELECT member_id, d AS event_date,
  CAST(sum(CASE WHEN event_type = 'open_app' THEN 1 ELSE 0 END) AS BIGINT) AS logins_count,
  CAST(sum(CASE WHEN event_type = 'view_metrics' THEN 1 ELSE 0 END) AS BIGINT) AS metric_views_count
FROM app_events GROUP BY ALL""")
_block("daily_chats", """
SELECT member_id, d AS event_date, count(*) AS chats_count,
  CAST(sum(CASE WHEN sender = 'member' AND regexp_matches(lower(message_text), 'cancel|freeze|terminate|decline') THEN 1 ELSE 0 END) AS BIGINT)
    AS cancellation_queries_count
FROM chats GROUP BY ALL""")
_block("daily_emails", """
SELECT member_id, d AS event_date, count(*) AS emails_sent,
  CAST(sum(CASE WHEN status IN ('Opened','Clicked') THEN 1 ELSE 0 END) AS BIGINT) AS emails_opened,
  CAST(sum(CASE WHEN status = 'Clicked' THEN 1 ELSE 0 END) AS BIGINT) AS emails_clicked
FROM emails GROUP BY ALL""")
_block("spine", """
SELECT m.*, gt.churned, gt.churn_date, mb.membership_tier, mb.monthly_price,
  CAST(unnest(generate_series(m.join_date, least(coalesce(gt.churn_date, (SELECT as_of_date FROM config)),
       (SELECT as_of_date FROM config)), INTERVAL 1 DAY)) AS DATE) AS date_day
FROM members m JOIN ground_truth gt USING (member_id) JOIN memberships mb USING (member_id)""")
_block("rolled", """
SELECT s.*,
  sum(coalesce(booked_count, 0)) OVER w7 AS b7, sum(coalesce(booked_count, 0)) OVER w30 AS b30,
  sum(coalesce(attended_count, 0)) OVER w7 AS a7, sum(coalesce(attended_count, 0)) OVER w30 AS a30,
  sum(coalesce(temp_sum, 0.0)) OVER w30 AS t30,
  max(CASE WHEN coalesce(attended_count, 0) > 0 THEN date_day END) OVER wall AS last_att,
  sum(coalesce(retail_spend, 0.0)) OVER w30 AS r30,
  sum(coalesce(membership_failed_count, 0)) OVER w30 AS f30,
  last_value(membership_status IGNORE NULLS) OVER wall AS last_status,
  sum(coalesce(logins_count, 0)) OVER w7 AS l7, sum(coalesce(logins_count, 0)) OVER w30 AS l30,
  sum(coalesce(metric_views_count, 0)) OVER w30 AS v30,
  sum(coalesce(chats_count, 0)) OVER w30 AS c30,
  sum(coalesce(cancellation_queries_count, 0)) OVER w30 AS q30,
  sum(coalesce(emails_sent, 0)) OVER w30 AS es30, sum(coalesce(emails_opened, 0)) OVER w30 AS eo30,
  sum(coalesce(emails_clicked, 0)) OVER w30 AS ec30
FROM spine s
LEFT JOIN daily_sessions ds ON s.member_id = ds.member_id AND s.date_day = ds.event_date
LEFT JOIN daily_transactions dt ON s.member_id = dt.member_id AND s.date_day = dt.event_date
LEFT JOIN daily_app_events da ON s.member_id = da.member_id AND s.date_day = da.event_date
LEFT JOIN daily_chats dc ON s.member_id = dc.member_id AND s.date_day = dc.event_date
LEFT JOIN daily_emails de ON s.member_id = de.member_id AND s.date_day = de.event_date
WINDOW w7 AS (PARTITION BY s.member_id ORDER BY date_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY s.member_id ORDER BY date_day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  wall AS (PARTITION BY s.member_id ORDER BY date_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_block("mart", """
SELECT i.hashed_member_id, date_day, (date_day - dob) / 365.25::DOUBLE AS age, gender, home_studio_id,
  membership_tier, monthly_price, CAST(date_day - join_date AS INTEGER) AS tenure_days,
  CAST(b7 AS INTEGER) AS sessions_booked_7d, CAST(b30 AS INTEGER) AS sessions_booked_30d,
  CAST(a7 AS INTEGER) AS sessions_attended_7d, CAST(a30 AS INTEGER) AS sessions_attended_30d,
  CASE WHEN b7 > 0 THEN CAST(a7 AS DOUBLE) / b7 END AS attendance_rate_7d,
  CASE WHEN b30 > 0 THEN CAST(a30 AS DOUBLE) / b30 END AS attendance_rate_30d,
  CASE WHEN a30 > 0 THEN t30 / a30 ELSE 0.0 END AS avg_sauna_temp_30d,
  CAST(coalesce(date_day - last_att, 999) AS BIGINT) AS days_since_last_session,
  r30 AS retail_spend_30d, coalesce(last_status = 'Failed', FALSE) AS last_recurring_payment_failed,
  CAST(f30 AS INTEGER) AS failed_payments_count_30d, CAST(l7 AS INTEGER) AS app_logins_7d,
  CAST(l30 AS INTEGER) AS app_logins_30d, CAST(v30 AS INTEGER) AS metric_views_30d,
  CAST(c30 AS INTEGER) AS coach_chat_count_30d, q30 > 0 AS has_cancellation_query_30d,
  CAST(es30 AS INTEGER) AS emails_sent_30d, CAST(eo30 AS INTEGER) AS emails_opened_30d,
  CAST(ec30 AS INTEGER) AS emails_clicked_30d,
  CASE WHEN es30 > 0 THEN CAST(eo30 AS DOUBLE) / es30 END AS email_open_rate_30d,
  coalesce(churned AND churn_date BETWEEN date_day + 1 AND date_day + 14, FALSE) AS is_churned_14d,
  TRUE AS is_synthetic
FROM rolled r JOIN identity i USING (member_id)""")
_block("snap", "SELECT * FROM mart WHERE date_day = (SELECT as_of_date FROM config)")
_block("snap_before", "SELECT * FROM mart WHERE date_day = (SELECT as_of_date FROM config) - 7")
_SCORE = """
SELECT hashed_member_id, score_date, p AS churn_probability,
  CASE WHEN p < 0.20 THEN 'Low' WHEN p < 0.50 THEN 'Medium' WHEN p < 0.85 THEN 'High' ELSE 'Critical' END AS risk_tier
FROM (SELECT hashed_member_id, date_day AS score_date,
        CAST(('0x' || left(sha256(hashed_member_id), 4)) AS INTEGER) / 65535.0::DOUBLE AS p FROM {src})"""
_block("scores", _SCORE.format(src="snap"))
_block("scores_before", _SCORE.format(src="snap_before"))
_block("panel_scores", _SCORE.format(src="mart").replace("sha256(hashed_member_id)", "sha256(hashed_member_id || CAST(date_day AS VARCHAR))"))
_LIFE = """
SELECT hashed_member_id, member_id,
  CASE WHEN is_cancelled THEN CASE WHEN gone IS NULL OR gone < 7 THEN 'cancelled' WHEN gone <= 90 THEN 'win_back_eligible' ELSE 'win_back_expired' END
       WHEN tenure_days <= 30 THEN 'onboarding'
       WHEN sessions_attended_30d = 0 AND days_since_last_session > 30 THEN 'lapsed'
       WHEN risk_tier IN ('Medium','High','Critical') THEN 'at_risk' ELSE 'engaged' END AS stage,
  home_studio_id, monthly_price, tenure_days, risk_tier, churn_probability, sessions_attended_30d,
  days_since_last_session, snapshot_date
FROM (
  SELECT f.hashed_member_id, i.member_id, FALSE AS is_cancelled, CAST(NULL AS BIGINT) AS gone, f.home_studio_id, f.monthly_price,
    f.tenure_days, s.risk_tier, s.churn_probability, f.sessions_attended_30d, f.days_since_last_session, f.date_day AS snapshot_date
  FROM {snap} f LEFT JOIN {scores} s ON s.hashed_member_id = f.hashed_member_id AND s.score_date = f.date_day
  LEFT JOIN identity i ON i.hashed_member_id = f.hashed_member_id
  UNION ALL
  SELECT i.hashed_member_id, g.member_id, TRUE, {day} - g.churn_date, mb.studio_id, mb.monthly_price, 0, 'N/A', 1.0, 0, 999, {day}
  FROM ground_truth g JOIN identity i ON i.member_id = g.member_id LEFT JOIN memberships mb ON mb.member_id = g.member_id
  WHERE g.churned AND g.member_id NOT IN (SELECT member_id FROM {snap} JOIN identity USING (hashed_member_id)))"""
_block("life_now", _LIFE.format(snap="snap", scores="scores", day="(SELECT as_of_date FROM config)"))
_block("life_before", _LIFE.format(snap="snap_before", scores="scores_before", day="(SELECT as_of_date - 7 FROM config)"))
_block("lifecycle", """
SELECT n.*, p.stage AS previous_stage,
  CASE WHEN p.stage = n.stage THEN p.snapshot_date ELSE n.snapshot_date END AS stage_entered_at,
  CASE WHEN p.stage = n.stage THEN 1 ELSE 0 END AS days_in_stage
FROM life_now n LEFT JOIN life_before p USING (hashed_member_id)""")
_block("engagement", """
SELECT *, CASE WHEN membership_tier = 'Basic' AND engagement_score >= 70 THEN 'upsell_candidate'
    WHEN membership_tier = 'Premium' AND engagement_score < 40 THEN 'under_engaged_payer'
    WHEN engagement_score < 25 THEN 'at_risk_silent' WHEN engagement_score >= 75 THEN 'champion' ELSE 'engaged' END AS segment
FROM (SELECT hashed_member_id, home_studio_id, membership_tier, monthly_price,
    round_even(0.35 * su + 0.25 * au + 0.15 * er + 0.15 * rs + 0.10 * co, 1) AS engagement_score,
    round_even(su, 1) AS session_utilization, round_even(au, 1) AS app_usage, round_even(er, 1) AS email_response,
    round_even(rs, 1) AS retail_spend, round_even(co, 1) AS consistency, churn_probability, risk_tier
  FROM (SELECT f.*, s.churn_probability, s.risk_tier,
      least(greatest(sessions_attended_30d, 0) / 12.0::DOUBLE, 1.0) * 100 AS su,
      least(greatest(app_logins_30d, 0) / 20.0::DOUBLE, 1.0) * 100 AS au,
      least(greatest(coalesce(email_open_rate_30d, 0), 0), 1) * 100 AS er,
      least(greatest(round(retail_spend_30d, 6), 0) / 50.0::DOUBLE, 1.0) * 100 AS rs,
      least(greatest(1 - days_since_last_session / 30.0::DOUBLE, 0), 1) * 100 AS co
    FROM snap f LEFT JOIN scores s USING (hashed_member_id)))""")
_block("audit", """
SELECT 'AU' || e AS audit_id, member_id, hashed_member_id, ts AS sent_at,
  CASE e % 5 WHEN 0 THEN 'Email' WHEN 1 THEN 'SMS' WHEN 2 THEN 'Call' WHEN 3 THEN 'WinBackEmail' ELSE 'Push' END AS action_type,
  CASE WHEN user_id % 7 = 0 THEN 'Holdout' WHEN e % 2 = 0 THEN 'Sent' ELSE 'DryRun' END AS status,
  'Score: 0.5 | Tier: ' || CASE e % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS why_score
FROM ev JOIN identity USING (member_id) WHERE event_type = 'signup'""")
_block("outcome_base", """
SELECT a.audit_id, a.member_id, a.hashed_member_id, CAST(a.sent_at AS DATE) AS sd, a.action_type,
  split_part(why_score, 'Tier: ', 2) AS risk_tier, coalesce(g.churned, FALSE) AS churned, g.churn_date
FROM audit a LEFT JOIN ground_truth g USING (member_id) WHERE a.status IN ('Sent','DryRun')""")
_block("outcome_days", """
SELECT o.audit_id, count(DISTINCT CASE WHEN s.d <= o.sd + 7 THEN s.d END) AS n7,
  count(DISTINCT CASE WHEN s.d <= o.sd + 14 THEN s.d END) AS n14,
  count(DISTINCT CASE WHEN s.d <= o.sd + 30 THEN s.d END) AS n30, min(s.d) AS re_engaged_date
FROM outcome_base o LEFT JOIN (SELECT DISTINCT member_id, d FROM sessions WHERE attended) s
  ON s.member_id = o.member_id AND s.d > o.sd GROUP BY o.audit_id""")
_block("outcome_pays", """
SELECT o.audit_id, min(t.d) AS paid_date FROM outcome_base o
LEFT JOIN (SELECT DISTINCT member_id, transaction_date AS d FROM transactions WHERE transaction_type = 'Membership Fee' AND status = 'Paid') t
  ON t.member_id = o.member_id AND t.d > o.sd GROUP BY o.audit_id""")
_CLS = """CASE WHEN n{n} > 0 THEN 're_engaged' WHEN paid_date <= sd + {n} THEN 'payment_resolved'
  WHEN churned AND churn_date <= sd + {n} THEN 'churned' WHEN NOT churned THEN 'still_active' ELSE 'no_response' END AS outcome_{n}d"""
_block("outcomes", f"""
SELECT audit_id, member_id, hashed_member_id, sd AS intervention_date, action_type, risk_tier,
  {_CLS.format(n=7)}, {_CLS.format(n=14)}, {_CLS.format(n=30)},
  re_engaged_date, paid_date AS payment_resolved_date, coalesce(paid_date <= sd + 30, FALSE) AS payment_resolved_within_30d,
  n7 AS sessions_post_7d, n14 AS sessions_post_14d, n30 AS sessions_post_30d,
  coalesce(churned AND churn_date > sd AND churn_date <= sd + 30, FALSE) AS churned_within_30d
FROM outcome_base JOIN outcome_days USING (audit_id) JOIN outcome_pays USING (audit_id)""")
_block("treated", """
SELECT o.*, coalesce(l.monthly_price, 0.0) AS monthly_price, coalesce(l.churn_probability, 0.0) AS churn_probability,
  coalesce(l.stage, 'unknown') AS stage, l.home_studio_id,
  CASE WHEN coalesce(l.stage, 'unknown') IN ('win_back_eligible','win_back_expired','cancelled') THEN 'reactivation' ELSE 'retention' END AS segment,
  CASE WHEN coalesce(l.stage, 'unknown') IN ('win_back_eligible','win_back_expired','cancelled') THEN 0.08::DOUBLE ELSE 0.25::DOUBLE END AS effectiveness,
  coalesce(l.churn_probability, 0.0) * coalesce(l.monthly_price, 0.0) AS targeted_mrr,
  CASE WHEN o.is_lost THEN coalesce(l.monthly_price, 0.0) ELSE 0.0 END AS lost_mrr
FROM (SELECT hashed_member_id, count(*) AS touches, bool_or(churned_within_30d) AS is_lost,
    bool_or(outcome_30d IN ('re_engaged','payment_resolved')) AS confirmed_save,
    (SELECT action_type FROM outcomes q WHERE q.hashed_member_id = o.hashed_member_id GROUP BY action_type ORDER BY count(*) DESC, action_type LIMIT 1) AS primary_channel
  FROM outcomes o GROUP BY hashed_member_id) o
LEFT JOIN life_now l USING (hashed_member_id)""")
_block("costed", """
SELECT *, CASE action_type WHEN 'Email' THEN 0.01::DECIMAL(12,4) WHEN 'WinBackEmail' THEN 0.01 WHEN 'SMS' THEN 0.05
  WHEN 'Push' THEN 0.005 WHEN 'Call' THEN 5.0 ELSE 0.01 END AS cost FROM outcomes""")
_block("o_members", """
SELECT 'M' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS member_id, CAST(min(o_orderdate) AS DATE) AS join_date,
  'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS home_studio_id,
  CASE c_custkey % 3 WHEN 0 THEN 'steady' WHEN 1 THEN 'declining' ELSE 'sudden_drop' END AS cohort,
  max(o_orderdate) < TIMESTAMP '2001-02-01' AS churned,
  CASE WHEN max(o_orderdate) < TIMESTAMP '2001-02-01' THEN CAST(max(o_orderdate) AS DATE) END AS churn_date
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey""")
_block("o_as_of", "SELECT CAST(max(o_orderdate) AS DATE) AS as_of_date FROM orders")
_block("auth", """
SELECT event_id AS line, ts, 'user' || user_id AS username,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' ELSE 'lockout' END AS outcome,
  CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 'src' || (user_id % 13) END AS source FROM events""")
_block("people", """
SELECT c_custkey AS k, c_acctbal, concat_ws(' ', p_name, n_name) AS full_name, lower(replace(c_name, '#', '.')) AS local,
  lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') AS area, lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS tail
FROM customer LEFT JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""")
_block("pos", """
SELECT 'M' || lpad(CAST(k AS VARCHAR), 10, '0') AS member_id, k AS row_order, full_name AS name,
  local || '@example.test' AS email, '+1 ' || area || '-' || tail AS phone FROM people""")
_block("app", """
SELECT 'A' || lpad(CAST(k AS VARCHAR), 10, '0') AS app_member_id, k AS row_order,
  CASE WHEN k % 8 = 0 THEN full_name || ' Jr.' ELSE full_name END AS name,
  CASE WHEN k % 6 = 0 THEN NULL WHEN k % 4 = 0 THEN local || '@mail.test' ELSE upper(local) || '@EXAMPLE.TEST ' END AS email,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN area || '9' || substr(tail, 2, 6) ELSE area || tail END AS phone
FROM people WHERE c_acctbal >= 0
UNION ALL
SELECT 'B' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), s_suppkey + 1000000000, s_name,
  lower(replace(s_name, '#', '.')) || '@supply.test', NULL FROM supplier""")
_NORM = """SELECT *, lower(trim(coalesce(email, ''))) AS ne,
  CASE WHEN length(dg) = 11 AND dg LIKE '1%' THEN substr(dg, 2) ELSE dg END AS np,
  regexp_replace(lower(trim(coalesce(name, ''))), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS nn
FROM (SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS dg FROM {src})"""
_block("posn", _NORM.format(src="pos"))
_block("appn", _NORM.format(src="app"))
_PAIR = """
SELECT p.member_id, a.app_member_id FROM
  (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_order) AS rn FROM posn WHERE {k} <> '' {fp}) p
JOIN (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_order) AS rn FROM appn WHERE {k} <> '' {fa}) a
  ON p.{k} = a.{k} AND p.rn = a.rn"""
_block("email_match", _PAIR.format(k="ne", fp="", fa=""))
_block("phone_match", _PAIR.format(
    k="np", fp="AND member_id NOT IN (SELECT member_id FROM email_match)",
    fa="AND app_member_id NOT IN (SELECT app_member_id FROM email_match)"))
_block("exact_match", """
SELECT *, 'email' AS layer FROM email_match UNION ALL SELECT *, 'phone' FROM phone_match""")
_block("fuzzy_pairs", """
SELECT DISTINCT p.member_id, p.row_order AS po, a.app_member_id, a.row_order AS ao
FROM posn p JOIN appn a ON (p.ne <> '' AND a.ne <> '' AND split_part(p.ne, '@', 1) = split_part(a.ne, '@', 1))
  OR (p.np <> '' AND a.np <> '' AND left(p.np, 3) = left(a.np, 3))
WHERE p.member_id NOT IN (SELECT member_id FROM exact_match) AND a.app_member_id NOT IN (SELECT app_member_id FROM exact_match)
  AND jaro_winkler_similarity(regexp_replace(p.nn, '\\s', '', 'g'), regexp_replace(a.nn, '\\s', '', 'g')) >= 0.85""")
_block("choices", """
SELECT member_id, row_number() OVER (ORDER BY po) AS i, cands FROM
  (SELECT member_id, po, list(app_member_id ORDER BY ao) AS cands FROM fuzzy_pairs GROUP BY 1, 2)""")
_block("served", """
SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS member_id, CAST(NULL AS VARCHAR) AS app_member_id
UNION ALL SELECT c.i, list_append(s.used, list_filter(c.cands, lambda x: NOT list_contains(s.used, x))[1]), c.member_id,
  list_filter(c.cands, lambda x: NOT list_contains(s.used, x))[1] FROM served s JOIN choices c ON c.i = s.i + 1""")
_block("matches", """
SELECT member_id, app_member_id FROM exact_match
UNION ALL SELECT member_id, app_member_id FROM served WHERE app_member_id IS NOT NULL""")
_block("holdout", f"""
SELECT member_id, CAST(('0x' || right(sha256(concat(member_id, '{HOLDOUT_SALT}')), 4)) AS INTEGER) % 10 = 0 AS is_holdout FROM identity""")

_WORD = re.compile(r"[a-z_]+")


def with_blocks(select: str) -> str:
    """Prefix a select with the CTEs it uses, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(_WORD.findall(sql)) & BLOCKS.keys():
            if word not in needed:
                needed.add(word)
                visit(BLOCKS[word])

    visit(select)
    once = {"fuzzy_pairs", "choices", "mart"}
    ctes = [
        f"{name} AS {'MATERIALIZED ' if name in once else ''}({sql})"
        for name, sql in BLOCKS.items() if name in needed
    ]
    recursive = "RECURSIVE " if "served" in needed else ""
    return (f"WITH {recursive}{', '.join(ctes)} " if ctes else "") + select.strip()
