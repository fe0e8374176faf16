"""Streams over files give the rows of the batch; late rows are dropped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import activity as S, lockout
from tidemark.streaming.runner import run_available

SCHEMA = "member_id string, ts timestamp, kind string"


def _stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _events(spark):
    base = dt.datetime(2024, 1, 1, 6)
    kinds = ["attended", "open_app", "view_metrics", "Clicked"]
    rows = [(f"m{i % 3}", base + dt.timedelta(hours=5 * i), kinds[i % 4]) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("fn, closing", [(S.stream_daily_activity, 3), (S.stream_rolling_activity, 40), (S.stream_member_sessions, 3)])
def test_stream_equals_batch(spark, tmp_path, fn, closing):
    df, rows = _events(spark)
    # A far later event moves the watermark so that all earlier windows are final.
    tail = spark.createDataFrame([("end", rows[-1][1] + dt.timedelta(days=closing + 3), "open_app")], SCHEMA)
    path = tmp_path / "in"
    df.coalesce(1).write.parquet(str(path))
    tail.coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = {tuple(r) for r in run_available(fn(stream), "t").collect() if r.member_id != "end"}
    want = {tuple(r) for r in fn(df).collect()}
    assert got == want and want


def test_late_rows_are_dropped(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d, 12)
    path = tmp_path / "in"
    # Late rows are judged by the watermark of the batch before, hence two files at day 9.
    for day in (1, 9, 9, 1, 20):
        spark.createDataFrame([("m", t(day), "open_app")], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = {r.event_date: r.events for r in run_available(S.stream_daily_activity(stream), "late").collect()}
    assert got[dt.date(2024, 1, 1)] == 1


def test_flags_are_raised_once(spark, tmp_path):
    tx = spark.createDataFrame([("t1", "m", dt.date(2024, 1, 1), "Failed"), ("t1", "m", dt.date(2024, 1, 1), "Failed"), ("t2", "m", dt.date(2024, 1, 1), "Paid")],
                               "transaction_id string, member_id string, transaction_date date, status string")
    chats = spark.createDataFrame([("c1", "m", dt.datetime(2024, 1, 1, 1), "member", "Cancel please"), ("c2", "m", dt.datetime(2024, 1, 1, 1), "coach", "cancel")],
                                  "chat_id string, member_id string, timestamp timestamp, sender string, message_text string")
    out = run_available(S.stream_intent_flags(_stream(spark, tx, tmp_path / "tx"), _stream(spark, chats, tmp_path / "ch")), "flags")
    assert sorted((r.event_id, r.flag) for r in out.collect()) == [("c1", "cancel_question"), ("t1", "payment_failed")]


def test_send_guard_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 10)
    rows = [(base + dt.timedelta(minutes=i // 2), "Sent") for i in range(60)] + [(base, "DryRun")] * 99 + [(base + dt.timedelta(days=1), "Sent")]
    df = spark.createDataFrame(rows, "sent_at timestamp, status string")
    got = run_available(S.stream_send_rate_guard(_stream(spark, df, tmp_path / "a")), "guard").collect()
    assert got == [] or max(r.sends for r in got) == 60
    assert max(r.sends for r in S.stream_send_rate_guard(df).collect()) == 60


def test_lockout_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 10)
    at = lambda m: base + dt.timedelta(minutes=m)
    rows = [("Eve", at(m), "failure") for m in range(6)] + [("eve", at(30 + m), "failure") for m in range(5)]
    rows += [("bob", at(m), "failure") for m in range(4)] + [("bob", at(4), "success"), ("bob", at(5), "failure")]
    rows += [("slow", at(m), "failure") for m in (0, 10, 20, 30, 40)]
    df = spark.createDataFrame(rows, "username string, ts timestamp, outcome string")
    out = run_available(lockout.stream_lockout(_stream(spark, df, tmp_path / "l")), "lock").collect()
    assert sorted((r.key_value, r.locked_at, r.failures) for r in out) == [("eve", at(4), 5), ("eve", at(34), 5)]


def test_lockout_stream_by_source_counts_all(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 10)
    rows = [(f"u{i}", base + dt.timedelta(minutes=i // 9), "failure", "s1") for i in range(18)] + [("u1", base, "failure", "unknown")] * 3
    df = spark.createDataFrame(rows, "username string, ts timestamp, outcome string, source string")
    out = run_available(lockout.stream_lockout(_stream(spark, df, tmp_path / "s")), "lock-source").collect()
    assert [(r.key_type, r.key_value, r.locked_at, r.failures) for r in out] == [("source", "s1", base, 9)]


def test_late_rows_of_a_second_delivery_are_told(spark):
    from tidemark.streaming.runner import run_deliveries

    t = lambda d, m="m": (m, dt.datetime(2024, 1, d, 12), "open_app")
    first = spark.createDataFrame([t(1), t(2), t(9), t(9, "n")], SCHEMA)
    second = spark.createDataFrame([t(1), t(1), t(8), t(10), t(2, "n")], SCHEMA)
    far = spark.createDataFrame([("end", dt.datetime(2024, 3, 1), "open_app")], SCHEMA)
    # After the first delivery days up to the 7th are final; the 8th still counts.
    late = {(r.member_id, r.event_date.day): r.rows for r in run_deliveries([first, second, far], S.stream_late_rows, "t").collect()}
    assert late == {("m", 1): 2, ("n", 2): 1}
    days = {(r.member_id, r.event_date.day): r.events for r in run_deliveries([first, second, far], S.stream_daily_activity, "t").collect()}
    assert days == {("m", 1): 1, ("m", 2): 1, ("m", 8): 1, ("m", 9): 1, ("n", 9): 1, ("m", 10): 1}


def test_an_event_after_exactly_the_gap_begins_a_new_session(spark, tmp_path):
    t = lambda m, us=0: dt.datetime(2024, 1, 1, 0, m, 0, us)
    at = [t(0), t(30), t(59, 999_999), t(59, 999_999)]
    df = spark.createDataFrame([("m", ts, "open_app") for ts in at] + [("end", dt.datetime(2024, 2, 1), "open_app")], SCHEMA)
    want = [(t(0), t(30), 1), (t(30), dt.datetime(2024, 1, 1, 1, 29, 0, 999_999), 3)]
    for rows in (S.stream_member_sessions(df), run_available(S.stream_member_sessions(_stream(spark, df, tmp_path / "s")), "t")):
        got = sorted((r.session_start, r.session_end, r.events) for r in rows.collect() if r.member_id == "m")
        assert got == want


def test_late_rows_are_counted_by_day_not_by_member(spark, tmp_path):
    from tidemark.streaming.runner import run_deliveries

    t = dt.datetime
    rows = [(m, t(2024, 1, 1, h), "x") for m in ("a", "b", None) for h in range(2)]
    frame = lambda r: spark.createDataFrame(r, "member_id string, ts timestamp, kind string")
    keys = []

    def build(events):
        out = S.stream_late_rows(events)
        keys.append(out._jdf.queryExecution().analyzed().toString().split("\n")[0])
        return out

    out = run_deliveries([frame([("z", t(2024, 2, 1), "x")]), frame(rows), frame([("z", t(2024, 3, 1), "x")])], build, "late")
    assert sorted((r.member_id or "", r.event_date.day, r.rows) for r in out.collect()) == [("", 1, 2), ("a", 1, 2), ("b", 1, 2)]
    assert all("[event_date#" in k and ", part#" in k for k in keys)


def test_rolling_history_equals_the_stream_and_is_shuffled_once(spark):
    t = dt.datetime
    rows = [(f"m{i % 7}", t(2024, 1, 1) + dt.timedelta(hours=11 * i), k) for i in range(90) for k in ("attended", "chat", "Clicked")]
    events = spark.createDataFrame([*rows, ("m1", None, "chat")], "member_id string, ts timestamp_ntz, kind string")
    got = S.rolling_activity(events, rows_per_task=500)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(S.stream_rolling_activity(events))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(member_id" in plan
