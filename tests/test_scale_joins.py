"""Joins of tables that grow with the input send no side to the driver, however small its files look."""

from tidemark.operators import features, identity
from tidemark.plans.queries import frames_for
from tidemark.sources import bindings as B


def test_people_are_matched_without_broadcasts_of_growing_tables(spark, sf_dir):
    pos, app = frames_for(spark, sf_dir).people
    exact = identity.match_exact_contacts(pos, app)
    # Nation, of fixed size, is the only table that may be broadcast.
    for frame, broadcasts in ((pos, 1), (app, 1), (exact, 0), (identity._without(pos, exact, "member_id"), 1)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == broadcasts


def test_audit_and_routes_are_joined_without_broadcasts(spark, sf_dir):
    f = frames_for(spark, sf_dir)
    for frame in (f.audit, f.intervention_outcomes()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_order_years_are_joined_without_a_broadcast(spark, sf_dir):
    plan = frames_for(spark, sf_dir).order_history._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_panel_windows_see_only_days_of_change(spark, sf_dir):
    t = B.activity_domain(spark, sf_dir)
    widths = {"salt": "s", "short_days": 5, "long_days": 12}
    panel = features.member_features_daily(t, as_of="2024-01-25", **widths)
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    # The plan is printed from the result down: days are spelled out after the windows, not before.
    assert plan.index("explode(sequence") < plan.index("Window [")
    rows = {}
    for r in _rounded(panel):
        rows.setdefault(str(r[1]), []).append(r)
    for day in ("2024-01-01", "2024-01-12", "2024-01-13", "2024-01-25"):
        want = _rounded(features.member_features_snapshot(t, as_of=day, **widths))
        assert len(want) > 50 and rows[day] == want
    since = features.member_features_daily(t, as_of="2024-01-25", since="2024-01-12", **widths)
    assert _rounded(since) == sorted((x for d, some in rows.items() if d >= "2024-01-12" for x in some), key=repr)


def _rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
