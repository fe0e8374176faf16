"""Registered queries against their check SQL on the smallest data set."""

import math

import duckdb
import pytest

from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES, bound

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAMPLE = [
    "daily_transactions", "member_features_daily", "member_features_incremental",
    "member_features_snapshot_earlier", "risk_reasons", "scope_to_studio", "first_last_days",
    "lifecycle_stage", "stage_transition", "engagement_score", "intervention_outcomes",
    "conversion_rates", "treated_members", "revenue_summary", "studio_leaderboard", "km_retention",
    "winback_leaderboard", "observed_reactivations", "route_churn_actions", "route_lifecycle_actions",
    "route_segment_actions", "send_cap", "ab_lift", "ab_significance", "studio_digest",
    "member_payload", "finalize_summaries", "dq_foreign_keys", "record_hash", "lockout_status",
    "oversight_log", "match_exact_contacts", "fuzzy_candidates", "resolve_identities", "auc_roc",
    "average_precision", "precision_at_top_k", "calibration_deciles", "feature_drift", "psi",
    "chronological_split", "active_at_month", "booking_heatmap", "stream_rolling_activity",
    "stream_member_sessions", "stream_send_rate_guard",
]


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_check_sql(spark, sf_dir, duck, name):
    df = bound(name)(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == _rows(columns, cur.fetchall())
