"""Tables by day and by key: daily runs against the panel, and which files a read or a change touches."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F
from test_rules import _tables

from tidemark.operators import daily_state, features, scoring
from tidemark.session import checkpointed
from tidemark.sources import sinks
from tidemark.sources.store import DayTable, KeyTable, MemberStore

D = dt.date


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = MemberStore(spark, str(tmp_path_factory.mktemp("members")), salt="s", buckets=4)
    s.add_feeds(_tables(spark))
    return s


def test_daily_runs_equal_the_panel(spark, store):
    t = _tables(spark)
    panel = features.member_features_daily(t, salt="s").cache()
    # Before anyone joined, and over a fee, a visit, a churn and days without any activity.
    before = D(2023, 12, 31)
    store.start(t, before)
    steps = [0, 1, 10, 33, 35, 51, 52, 59]
    for last, n in zip(steps, steps[1:]):
        day = before + dt.timedelta(days=n)
        store.advance(t, before + dt.timedelta(days=last), day)
        want = _rows(panel.filter(F.col("date_day") == F.lit(day)))
        assert _rows(store.panel_of(t, day)) == want
        assert _rows(store.state.read(day, day)) == _rows(daily_state.initial_state(t, day))
    for first, last in (("2024-01-04", "2024-01-09"), ("2024-01-30", "2024-02-28"), ("2024-02-27", "2024-02-28")):
        want = _rows(panel.filter(F.col("date_day").between(F.lit(first).cast("date") + F.expr("INTERVAL 1 DAY"), F.lit(last).cast("date"))))
        assert want and _rows(store.panel_after(t, first, last)) == want
    panel.unpersist()


def test_a_day_can_be_run_again(spark, store):
    t = _tables(spark)
    store.start(t, "2024-01-30")
    for _ in range(2):
        store.add_feeds(t)
        store.advance(t, "2024-01-30", "2024-01-31")
        assert _rows(store.state.read("2024-01-31", "2024-01-31")) == _rows(daily_state.initial_state(t, "2024-01-31"))
    ring = {r.member_id: r.ring for r in store.state.read("2024-01-31", "2024-01-31").collect()}
    assert all(e.day > (D(2024, 1, 31) - D(1970, 1, 1)).days - 30 for r in ring.values() for e in r)


def test_a_daily_run_reads_one_day_of_each_feed(spark, store):
    t = _tables(spark)
    store.start(t, "2024-01-30")
    plan = _plan(store.panel_after(t, "2024-01-30", "2024-01-31"))
    days = re.findall(r"PartitionFilters: \[[^\]]*feed_day[^\]]*>= 2024-01-31\), \(feed_day#\d+ <= 2024-01-31\)", plan)
    assert len(days) == 5
    read = store.feed_days(t, "2024-01-31", "2024-01-31")["sessions"]
    assert {os.path.basename(os.path.dirname(p)) for p in read.inputFiles()} <= {f"feed_day=2024-01-{d:02}" for d in range(1, 32)} | {
        "feed_day=2024-02-25", "feed_day=2024-02-28"}
    assert read.count() == 1


def test_scoped_reads_prune_files(spark, store):
    t = _tables(spark)
    store.rebuild_panel(t)
    panel, identity = store.panel.read(), features._member_frame(t, "s").select("member_id", "hashed_member_id")
    assert _rows(panel.select(*features.FEATURE_COLUMNS)) == _rows(features.member_features_daily(t, salt="s"))
    one = scoring.member_lookup(identity, panel, "b")
    assert "SelectedBucketsCount: 1 out of 4" in _plan(one)
    assert [r.day_no for r in one.orderBy("day_no").collect()] == [1, 2, 3, 4, 5, *range(41, 51)]
    assert scoring.member_lookup(identity, panel, "nobody").count() == 0
    scoped = scoring.scope_to_studio({"features": panel, "identity": identity, "scores": identity}, "S1")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(home_studio_id,S1\)", _plan(scoped["features"]))
    assert scoped["identity"].count() == 1
    assert "PartitionFilters: [isnotnull(date_day" in _plan(store.panel.read("2024-02-01", "2024-02-01"))


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_change_rewrites_only_the_folders_of_its_keys(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "t"), "k", buckets=64)
    table.create(spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    before = _files(table.path)
    new = checkpointed(spark.createDataFrame([(str(i), -1) for i in (*range(0, 900, 100), 9999)], "k string, v long"))
    touched = table.change(new, lambda rows, new: sinks.upsert(rows, new, ["k"]))
    after = _files(table.path)
    folders = {os.path.basename(os.path.dirname(p)) for p in before ^ after}
    assert len(touched) <= 10 and folders == {f"key_bucket={n}" for n in touched}
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 5001 and {k for k, v in got.items() if v == -1} == {str(i) for i in (*range(0, 900, 100), 9999)}
    assert table.change(new.limit(0), lambda rows, new: sinks.upsert(rows, new, ["k"])) == [] and _files(table.path) == after


def test_completions_rewrite_only_their_part_of_the_queue(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "q"), "action_id", buckets=32)
    now = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    table.create(spark.range(400).select(
        F.concat(F.lit("x"), F.col("id")).alias("action_id"), F.lit("m").alias("member_id"), F.lit("h").alias("hashed_member_id"),
        F.lit("Call").alias("action_type"), F.lit("Pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("processed_at")))
    before = _files(table.path)
    done = checkpointed(spark.createDataFrame([("x7", "Answered", None), ("x8", "Busy", "n"), ("gone", "Busy", None)],
                                              "action_id string, outcome string, notes string"))
    touched = table.change(done, lambda rows, done: sinks.complete_actions(rows, done, now)[0])
    assert {os.path.basename(os.path.dirname(p)) for p in before ^ _files(table.path)} <= {f"key_bucket={n}" for n in touched} and len(touched) <= 3
    rows = table.read().collect()
    assert len(rows) == 400 and {r.action_id for r in rows if r.status == "Sent" and r.processed_at} == {"x7", "x8"}


def test_a_day_without_a_state_is_built_from_the_newest_before_it(spark, tmp_path):
    t = _tables(spark)
    fresh = MemberStore(spark, str(tmp_path / "members"), salt="s", buckets=4)
    fresh.add_feeds(t)
    panel = features.member_features_daily(t, salt="s")
    for started in ("2024-01-10", "2024-01-02"):  # the newest state is after the day asked for, then two days before it
        fresh.start(t, started)
        want = _rows(panel.filter(F.col("date_day") == "2024-01-05"))
        assert want and _rows(fresh.panel_after(t, "2024-01-04", "2024-01-05")) == want
    fresh.advance(t, "2024-01-04", "2024-01-05")
    assert _rows(fresh.state.read("2024-01-05", "2024-01-05")) == _rows(daily_state.initial_state(t, "2024-01-05"))


def test_a_bucket_of_many_rows_is_written_by_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = DayTable(spark, str(tmp_path / "days"), "day", "k", buckets=1)
        rows = spark.range(40000).select(
            F.sha2(F.col("id").cast("string"), 256).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"))
        table.write(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len({os.path.basename(p)[:10] for p in _files(table.path)}) > 1
    assert table.read().count() == 40000 and table.read().select("k").distinct().count() == 40000


def test_first_and_last_days_are_sorted_once(spark):
    rows = [(m, D(2024, 1, 1) + dt.timedelta(days=i)) for m, n in (("a", 30), ("b", 3)) for i in range(n)]
    got = scoring.first_last_days(spark.createDataFrame(rows, "hashed_member_id string, date_day date"))
    assert _plan(got).count("Sort [") == 1
    days = sorted((r.hashed_member_id, r.day_no) for r in got.collect())
    assert days == [("a", n) for n in (1, 2, 3, 4, 5, *range(21, 31))] + [("b", n) for n in (1, 2, 3)]
