"""Log integrity, lockouts, writers, encryption, readers."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import contracts as C
from tidemark.operators import audit, model
from tidemark.sources import sinks, tables


def _chain(n=12):
    prev, lines = C.GENESIS_HASH, []
    for i in range(n):
        rec = {"ts": f"2024-01-01T00:00:{i:02d}+00:00", "event": "auth", "username": f"zoë {i} \U0001f600" if i == 3 else f"u{i}",
               "outcome": "failure", "source": "unknown", "reason": 'bad "quote" \\ /', "prev_hash": prev}
        body = prev + json.dumps(rec, sort_keys=True, separators=(",", ":"))
        rec["hash"] = hashlib.sha256(body.encode()).hexdigest()
        prev = rec["hash"]
        lines.append(json.dumps(rec))
    return lines


def _verify(spark, tmp_path, lines):
    path = tmp_path / "auth.log"
    path.write_text("\n".join(lines) + "\n")
    log = audit.parse_auth_lines(audit.number_lines(spark, str(path)))
    r = audit.verify_hash_chain(log).first()
    return r.ok, r.first_broken, r.records


def test_chain_intact_edited_deleted_malformed(spark, tmp_path):
    lines = _chain()
    assert _verify(spark, tmp_path, lines) == (True, None, 12)
    assert _verify(spark, tmp_path, lines[:5] + [""] + lines[5:]) == (True, None, 12)
    assert _verify(spark, tmp_path, lines[:4] + [lines[4].replace("failure", "success")] + lines[5:])[:2] == (False, 5)
    assert _verify(spark, tmp_path, lines[:6] + lines[7:])[:2] == (False, 7)
    assert _verify(spark, tmp_path, lines[:2] + ["{oops"] + lines[2:])[:2] == (False, 3)


def _events(spark, sizes):
    rows = [(n, f"u{who}", "2024-01-01", "auth", "failure", None, "src", f"2024-01-01 {n % 24:02d}:00:00")
            for n, who in enumerate(w for w, size in enumerate(sizes) for _ in range(size))]
    return spark.createDataFrame(rows, "line long, username string, day string, event string, outcome string, reason string, source string, ts string")


def _parsed(log):
    return audit.parse_auth_lines(log.select("seq", F.col("seq").alias("line"), F.col("line").alias("value")))


def test_long_chains_are_cut_into_segments_and_sealed(spark):
    """One user has most of the events; the chain equals a plain walk over its records."""
    log = audit.linked_log(_events(spark, [700, 5, 1]), ["username"], "line", segment=4).cache()
    by_user = {}
    for r in log.orderBy("username", "seq").collect():
        by_user.setdefault(r.username, []).append(json.loads(r.line))
    assert {u: len(x) for u, x in by_user.items()} == {"u0": 700, "u1": 5, "u2": 1}
    for rows in by_user.values():
        prev = None
        for n, row in enumerate(rows):
            if n % 4 == 0:
                prev = C.GENESIS_HASH if n == 0 else hashlib.sha256(f"{C.GENESIS_HASH}:{n // 4}".encode()).hexdigest()
            own = row.pop("hash")
            assert row["prev_hash"] == prev
            prev = hashlib.sha256((prev + json.dumps(row, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
            assert own == prev
    longest = log.groupBy("username", F.floor((F.col("seq") - 1) / 4)).count().agg(F.max("count")).first()[0]
    assert longest == 4

    parsed = _parsed(log)
    seals = audit.chain_seals(parsed, ["username"], segment=4).cache()
    assert sorted((r.username, r.records) for r in seals.collect()) == [("u0", 700), ("u1", 5), ("u2", 1)]

    def state(kept):
        rows = audit.verify_hash_chain(_parsed(kept), by=("username",), segment=4, seals=seals).collect()
        return {r.username: (r.ok, r.first_broken, r.records, r.sealed) for r in rows}

    fine = {"u0": (True, None, 700, True), "u1": (True, None, 5, True), "u2": (True, None, 1, True)}
    assert state(log) == fine
    big = F.col("username") == "u0"
    assert state(log.filter(~(big & (F.col("seq") > 696)))) == fine | {"u0": (False, None, 696, False)}
    assert state(log.filter(F.col("username") != "u2")) == fine | {"u2": (False, None, 0, False)}
    assert state(log.withColumn("line", F.when(big & (F.col("seq") == 301), F.replace("line", F.lit("src"), F.lit("else"))).otherwise(F.col("line")))) \
        == fine | {"u0": (False, 301, 700, True)}
    # Two segments put in each other's place keep their inner links.
    swapped = F.when(big & F.col("seq").between(5, 8), F.col("seq") + 4).when(big & F.col("seq").between(9, 12), F.col("seq") - 4).otherwise(F.col("seq"))
    assert state(log.withColumn("seq", swapped))["u0"] == (False, 5, 700, False)


def test_linking_makes_each_json_once(spark):
    """Texts that need escapes; no JSON is made or hashed inside the walk over a segment but once for a record."""
    odd = [(1, 'a"\\', "é\u20ac\U0001f600", "s", "o", None, "2024-01-01"), (2, "b\n", "\x7f", "", "o", "r", "2024-01-02")]
    events = spark.createDataFrame(odd, "line long, event string, username string, source string, outcome string, reason string, ts string").withColumn("k", F.lit(1))
    rows = [json.loads(r.line) for r in audit.linked_log(events, ["k"], "line").orderBy("seq").collect()]
    prev = C.GENESIS_HASH
    for row, want in zip(rows, odd):
        own = row.pop("hash")
        assert list(row) == [f for f in C.AUTH_LOG_SCHEMA.fieldNames() if f != "hash"]
        assert (row["event"], row["username"], row["reason"], row["prev_hash"]) == (want[1], want[2], want[5], prev)
        prev = hashlib.sha256((prev + json.dumps(row, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        assert own == prev
    walk = audit.linked_lines(F.array(audit.link_parts("r")), F.lit("0"))
    plan = spark.createDataFrame(odd, "line long, event string, username string, source string, outcome string, reason string, ts string").select(
        F.struct("*").alias("r")).select(walk.alias("lines"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sha2(") == 1


@pytest.mark.parametrize("edit", [
    lambda line: line[:-1] + ', "note": "forged"}', lambda line: line + " trailing", lambda line: line + "]", lambda line: line + "} x",
    lambda line: line + "," + line, lambda line: json.dumps({k: v for k, v in json.loads(line).items() if k != "reason"}),
    lambda line: line[:-1] + ', "outcome": "success"}', lambda line: "[" + line + "]",
])
def test_chain_edits_of_one_line(spark, tmp_path, edit):
    lines = _chain()
    assert _verify(spark, tmp_path, lines[:6] + [edit(lines[6])] + lines[7:])[:2] == (False, 7)
    assert _verify(spark, tmp_path, lines[:6] + [lines[6] + "  "] + lines[7:]) == (True, None, 12)


def test_auth_log_reader_skips_malformed(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(_chain(3) + ["{oops"]) + "\n")
    assert tables.read_auth_log(spark, str(tmp_path / "a.log")).count() == 3
    assert tables.read_auth_log(spark, str(tmp_path / "a.log"), keep_malformed=True).count() == 4


def test_lockout_window_reset_and_sources(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda m: now - dt.timedelta(minutes=m)
    rows = [("Eve", ago(m), "failure", "s1") for m in (1, 2, 3, 4, 14)]
    rows += [("bob", ago(m), "failure", "unknown") for m in (5, 6, 7, 8, 9)] + [("bob", ago(4), "success", "unknown"), ("bob", ago(1), "failure", "unknown")]
    rows += [("old", ago(m), "failure", "unknown") for m in (16, 17, 18, 19, 20)]
    ev = spark.createDataFrame(rows, "username string, ts timestamp_ntz, outcome string, source string")
    got = {(r.key_type, r.key_value): r for r in audit.lockout_status(ev, now=F.lit(now).cast("timestamp_ntz")).collect()}
    assert got[("username", "eve")].locked and got[("username", "eve")].seconds_remaining == 14 * 60
    assert got[("source", "s1")].locked
    assert not got[("username", "bob")].locked and got[("username", "bob")].failures == 1
    assert ("username", "old") not in got and ("source", "unknown") not in got


@pytest.mark.parametrize("ranges", [None, 7])
def test_oversight_carries_over_ranges(spark, ranges):
    """One admin has most of the accesses; the rest is compared with a plain walk."""
    import random

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(n, rng.choice("xxxxxxxy"), rng.choice("ABC"), start + dt.timedelta(minutes=rng.randrange(400))) for n in range(1, 900)]
    rows += [(1000, "z", "A", start), (1001, "z", "A", start + dt.timedelta(days=9))]
    df = spark.createDataFrame(rows, "access_id long, admin_user string, viewed_studio string, accessed_at timestamp_ntz")
    last, want = {}, []
    for access, admin, studio, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if last.get(admin) != studio:
            want.append(access)
        last[admin] = studio
    assert sorted(r.access_id for r in audit.oversight_log(df, ranges=ranges).collect()) == sorted(want)


def test_append_upsert_and_panel_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.append_table(a, path)
    sinks.append_table(a, path)
    assert spark.read.parquet(path).count() == 4
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(a, new, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    panel = str(tmp_path / "panel")
    rows = lambda d, n: spark.createDataFrame([(str(i), d) for i in range(n)], "hashed_member_id string, date_day date")
    sinks.write_daily_panel(rows(dt.date(2024, 1, 1), 3).unionByName(rows(dt.date(2024, 1, 2), 2)), panel)
    sinks.write_daily_panel(rows(dt.date(2024, 1, 2), 5), panel)
    assert {r.date_day: r["count"] for r in spark.read.parquet(panel).groupBy("date_day").count().collect()} == {
        dt.date(2024, 1, 1): 3, dt.date(2024, 1, 2): 5}


def test_encryption_fails_closed_and_round_trips(spark):
    df = spark.createDataFrame([("a", "x@y"), ("b", None)], "id string, email string")
    for key in (None, "", "short"):
        with pytest.raises(ValueError):
            sinks.encrypt_pii_columns(df, ["email"], key)
    key = "k" * 32
    sealed = sinks.encrypt_pii_columns(df, ["email"], key)
    assert sealed.filter("email = 'x@y'").count() == 0
    assert sorted(map(tuple, sinks.decrypt_pii_columns(sealed, ["email"], key).collect()), key=str) == [("a", "x@y"), ("b", None)]


def test_sources_fail_loudly(spark, tmp_path):
    with pytest.raises(Exception):
        tables.register_sources(spark, str(tmp_path), ["members"])
    with pytest.raises(ValueError):
        tables.load_table(spark, "members", mode="jdbc")
    with pytest.raises(ValueError):
        tables.load_table(spark, "members", mode="jdbc", url="jdbc:x", partition_column="id")
    with pytest.raises(ValueError):
        tables.stage(spark.createDataFrame([("a",)], "member_id string"), "members")


def test_empty_tables_are_typed_and_marks_survive(spark, tmp_path):
    empty = tables.empty_table(spark, C.AUDIT_SCHEMA)
    assert empty.count() == 0 and dict(empty.dtypes)["sent_at"] == "timestamp_ntz"
    path = str(tmp_path / "m")
    tables.mark_synthetic(spark.createDataFrame([("a",)], "id string")).write.parquet(path)
    assert tables.synthetic_marks(spark.read.parquet(path)) == {"id": "true"}


def test_training_is_sane_and_calibrated(spark):
    """A panel whose label follows idle days: ranking must beat chance by far."""
    import random

    rng = random.Random(0)
    rows = []
    for i in range(1500):
        idle = rng.randrange(60)
        rows.append((f"h{i}", dt.date(2024, 1, 1) + dt.timedelta(days=i % 50), idle, rng.random() < (0.6 if idle > 40 else 0.02)))
    df = spark.createDataFrame(rows, "hashed_member_id string, date_day date, days_since_last_session int, is_churned_14d boolean")
    df = df.withColumns({c: F.lit(1.0) for c in C.NUMERIC_FEATURES if c != "days_since_last_session"})
    df = df.withColumns({**{c: F.lit("x") for c in C.CATEGORICAL_FEATURES}, **{c: F.lit(False) for c in C.BOOLEAN_FEATURES}})
    train, held = model.chronological_split(df)
    fitted = model.calibrate_isotonic(model.train_churn_gbt(train, trees=5, depth=3), held)
    scored = fitted.predict(held).withColumn("actual", F.col(C.LABEL))
    from tidemark.operators import evaluation

    assert evaluation.auc_roc(scored).first().auc_roc > 0.8
    assert model.feature_importance(fitted, held, 1).first().feature == "days_since_last_session"
    assert scored.agg(F.avg("churn_probability") - F.avg(F.col("actual").cast("double"))).first()[0] == pytest.approx(0, abs=1e-6)


def test_the_newest_training_record_is_chosen(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("v1", t(1)), ("v3", t(9)), ("v2", t(9)), ("v4", t(3))]
    df = spark.createDataFrame(rows, "version_id string, trained_at timestamp_ntz")
    assert [r.version_id for r in model.registry_latest(df).collect()] == ["v3"]
    assert model.registry_latest(df.limit(0)).count() == 0


def test_the_registry_holds_both_runs_and_the_newest_is_latest(spark):
    from types import SimpleNamespace

    from tidemark.plans import queries

    rows = [(f"h{i}", dt.date(2024, 1, 1 + i), i % 3 == 0, i / 20) for i in range(20)]
    panel = spark.createDataFrame(rows, "hashed_member_id string, date_day date, is_churned_14d boolean, churn_probability double")
    frames = SimpleNamespace(
        split=(panel.filter("date_day < '2024-01-15'"), panel.filter("date_day >= '2024-01-15'")), panel=panel,
        trained=SimpleNamespace(predict=lambda df: df), as_of=F.lit("2024-02-10").cast("date"), model_path="churn-model-0a")
    got = {r.version_id: r for r in queries.model_registry(frames).collect()}
    assert {v: (r.window_months, r.rows_discarded_as_old) for v, r in got.items()} == {"v1": (1, 9), "v2": (24, 0)}
    assert queries.registry_latest(frames).collect() == [got["v2"]]


def test_rows_that_trees_cannot_tell_apart_are_one_weighted_row(spark):
    df = spark.range(4000).select(*[(F.col("id") % (1000 if c == "age" else 3)).cast("double").alias(c) for c in C.NUMERIC_FEATURES])
    bins = model.number_bins(df)
    binned = bins.transform(df)
    assert [binned.select(c).distinct().count() for c in bins.getOutputCols()[:2]] == [32, 3]
    cut = {c: s for c, s in zip(C.NUMERIC_FEATURES, bins.getSplitsArray())}
    assert cut["tenure_days"][1:-1] == [1.0, 2.0]
    rows = model.weighted_rows(binned, bins.getOutputCols(), lots=50).collect()
    assert len(rows) <= 100 and sum(r["rows"] for r in rows) == 4000
    # No row stands for more than its part of the draws.
    lots = model.weighted_rows(binned, bins.getOutputCols()[1:2], lots=10).collect()
    assert len(lots) == 12 and sum(r["rows"] for r in lots) == pytest.approx(4000) and max(r["rows"] for r in lots) <= 400
