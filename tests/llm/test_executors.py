"""The queries with workers that cannot import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tidemark.llm import queries
from tidemark.session import build_session

spark = build_session("alone", master="local[4]", **{{
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
spark.sparkContext.setLogLevel("OFF")


def importable(batches):
    import importlib.util

    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("tidemark") is not None]}})


assert not any(r.found for r in spark.range(4).mapInArrow(importable, "found boolean").collect())
for name, query in queries.QUERIES.items():
    query(spark, {sf_dir!r}).write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_workers_need_no_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, sf_dir=sf_dir)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=900)
    from tidemark.llm import queries

    assert ran.returncode == 0, ran.stderr[-3000:]
    assert [x.split()[1] for x in ran.stdout.splitlines() if x.startswith("done")] == list(queries.QUERIES)
