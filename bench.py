"""Time the headline queries and print one JSON line.

After a warm-up query each query runs ``BENCH_RUNS`` times and the best time counts.
Every row is computed and dropped (noop sink), nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.queries import bound  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "member_features_daily", "member_features_incremental", "member_features_snapshot",
    "lifecycle_stage", "stage_transition", "engagement_score", "intervention_outcomes",
    "conversion_rates", "revenue_summary", "studio_leaderboard", "km_retention",
    "route_churn_actions", "send_cap", "risk_kpis", "studio_digest", "member_payload",
    "match_exact_contacts", "resolve_identities", "calibration_deciles", "auc_roc",
    "feature_drift", "psi", "dq_foreign_keys", "oversight_log", "rolling_activity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        })
    spark.sparkContext.setLogLevel("OFF")
    bound("member_features_daily")(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            bound(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
