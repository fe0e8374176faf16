"""Identity layers against a plain walk over the records, with common names and contested records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.operators import identity

SCHEMA = "{} string, row_order long, name string, email string, phone string"


def _similar(a, b):
    """Jaro-Winkler with up to four letters of prefix, as usual."""
    a, b = "".join(a.lower().split()), "".join(b.lower().split())
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, [ch for j, ch in enumerate(b) if used[j]])) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def brute_force(pos, app, threshold=0.85):
    """Layers one after the other; in each, POS rows in order take their first free app row."""
    taken, out = set(), {}
    def local(r): return (r[3] or "").strip().lower().split("@")[0]
    def area(r): return "".join(c for c in r[4] or "" if c.isdigit())[-10:][:3]
    rules = [
        lambda p, a: bool(p[3] and a[3]) and p[3].strip().lower() == a[3].strip().lower(),
        lambda p, a: bool(p[4] and a[4]) and p[4] == a[4],
        lambda p, a: (bool(p[3] and a[3]) and local(p) == local(a) or bool(p[4] and a[4]) and area(p) == area(a)) and _similar(p[2], a[2]) >= threshold,
    ]
    for rule in rules:
        for p in sorted(pos, key=lambda r: r[1]):
            if p[0] not in out:
                for a in sorted(app, key=lambda r: r[1]):
                    if a[0] not in taken and rule(p, a):
                        out[p[0]] = a[0]
                        taken.add(a[0])
                        break
    return out


def _matched(spark, pos, app):
    frames = [spark.createDataFrame(rows, SCHEMA.format(key)) for rows, key in ((pos, "member_id"), (app, "app_member_id"))]
    rows = identity.resolve_identities(*frames, salt="s").collect()
    assert len(rows) == len(pos) + sum(r.member_id == "NONE" for r in rows)
    return {r.member_id: r.app_member_id for r in rows if "NONE" not in (r.member_id, r.app_member_id)}


@pytest.mark.parametrize("seed", range(6))
def test_cascade_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    names = ["anna lund", "anna lundt", "annal und", "jon dahl", "john dahl", "zoe", "anna lunds", "maria quist", "jon"]

    def rows(prefix, n):
        order = rng.sample(range(1000), n)
        return [(f"{prefix}{i}", order[i], rng.choice(names[:rng.choice((2, 9))]),
                 rng.choice([None, f"m{rng.randrange(25)}@{prefix}.x", f"m{rng.randrange(25)}@same.x"]),
                 rng.choice([None, f"{rng.choice((111, 222, 333))}555{rng.randrange(40):04d}"])) for i in range(n)]

    pos, app = rows("p", 60), rows("a", 55)
    assert _matched(spark, pos, app) == brute_force(pos, app)


def test_a_common_name_needs_no_pairs(spark, monkeypatch):
    """Ten thousand people of one name and area on both sides: matched by place, nothing is left to the rounds."""
    n, offered = 10_000, []
    pos = spark.range(n).select(
        F.concat(F.lit("p"), F.col("id")).alias("member_id"), ((F.col("id") * 7919) % n).alias("row_order"), F.lit("Anna Lund").alias("name"),
        F.concat(F.lit("anna"), F.col("id"), F.lit("@a.x")).alias("email"), F.concat(F.lit("111"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("phone"))
    app = spark.range(n - 3).select(
        F.concat(F.lit("a"), F.col("id")).alias("app_member_id"), ((F.col("id") * 104729) % 1_000_003).alias("row_order"), F.lit("anna lund").alias("name"),
        F.concat(F.lit("anna"), F.col("id"), F.lit("@b.x")).alias("email"), F.concat(F.lit("111"), F.lpad((F.col("id") + n).cast("string"), 7, "0")).alias("phone"))
    rounds = identity.assign_in_order
    monkeypatch.setattr(identity, "assign_in_order", lambda pairs: offered.append(pairs.count()) or rounds(pairs))
    rows = identity.resolve_identities(pos, app, salt="s").collect()
    got = {r.member_id: r.app_member_id for r in rows if r.member_id != "NONE" and r.app_member_id != "NONE"}
    in_order = [f"p{i}" for i in sorted(range(n), key=lambda i: i * 7919 % n)]
    others = [f"a{i}" for i in sorted(range(n - 3), key=lambda i: i * 104729 % 1_000_003)]
    assert got == dict(zip(in_order, others)) and offered == [0]


def test_closed_groups(spark):
    alike = spark.createDataFrame([("x", a, b) for a, b in (
        ("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "C"), ("3", "D"), ("4", "D"), ("5", "E"))] + [("y", "1", "A")],
        "block string, a string, b string")
    a, b = identity.closed_groups(alike)
    assert {(r.block, r.a) for r in a.collect()} == {("x", "1"), ("x", "2"), ("x", "5"), ("y", "1")}
    assert {(r.block, r.b) for r in b.collect()} == {("x", "A"), ("x", "B"), ("x", "E"), ("y", "A")}
    assert identity.closed_groups(alike.limit(0))[0].count() == 0


def test_names_of_many_pairs_in_one_step():
    """As the walk over letters has it: short, long and empty names, letters outside of ASCII, and more kinds of letters than bits."""
    rng = random.Random(11)
    names = ["", "x", "y"] + ["".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 14))) for _ in range(90)]
    names += ["".join(rng.choice("ab") for _ in range(rng.randrange(62, 70))) for _ in range(8)]
    names += ["".join(chr(0x4e00 + rng.randrange(600)) for _ in range(4)) + rng.choice(("", "b")) for _ in range(60)]
    names = sorted({*names, *(n[:-1] for n in names), *(n[::-1] for n in names)})
    a, b = (x.ravel() for x in np.meshgrid(*[np.arange(len(names))] * 2, indexing="ij"))
    for threshold in (0.7, 0.85):
        got = similarity.Names(names).alike(a, b, threshold)
        assert got.tolist() == [_similar(names[x], names[y]) >= threshold for x, y in zip(a, b)] and got.sum() > len(names)


def _crowd(seed):
    """People of a few areas with names that are alike to different sets of names; some share an email's name across areas."""
    rng = random.Random(seed)
    stems = ["annalund", "annelund", "annalundt", "johndahl", "johandahl", "mariaquist", "marianquist"]

    def rows(prefix, n):
        return [(f"{prefix}{i}", o, rng.choice(stems) + rng.choice("abcdefgh"), rng.choice([None, f"m{rng.randrange(40)}@{prefix}.x"]),
                 f"{rng.choice((111, 222, 333))}{prefix == 'a':d}55{i:04d}") for i, o in enumerate(rng.sample(range(9999), n))]

    return rows("p", 150), rows("a", 140)


def test_names_alike_to_different_names_are_settled_without_pairs(spark, monkeypatch):
    pos, app = _crowd(3)
    offered, rounds = [], identity.assign_in_order
    monkeypatch.setattr(identity, "assign_in_order", lambda pairs: offered.append(pairs.count()) or rounds(pairs))
    assert _matched(spark, pos, app) == brute_force(pos, app) and offered == [0]


def test_blocks_that_are_too_large_are_paired(spark, monkeypatch):
    """One area is too large for a task; what hangs together with it is settled in rounds, the rest is not."""
    pos, app = _crowd(4)
    pos, app = [(*r[:4], "4449990000") if i < 9 else r for i, r in enumerate(pos)], [(*r[:4], "4441110000") if i < 9 else r for i, r in enumerate(app)]
    pos, app = [(*r[:3], None, r[4]) if r[4][0] == "4" else r for r in pos], [(*r[:3], None, r[4]) if r[4][0] == "4" else r for r in app]
    offered, rounds = [], identity.assign_in_order
    monkeypatch.setattr(identity, "assign_in_order", lambda pairs: offered.append(pairs.count()) or rounds(pairs))
    monkeypatch.setattr(identity, "BLOCK_ROWS", 30)
    got = _matched(spark, pos, app)
    assert got == brute_force(pos, app) and offered[0] > 0


@pytest.mark.parametrize("lot_rows", [1, 7, 2048])
def test_candidates_are_listed_once(spark, monkeypatch, lot_rows):
    """Lots of any size; records that meet by email and by area, and an id that is there twice, give a pair once."""
    monkeypatch.setattr(identity, "LOT_ROWS", lot_rows)
    def frame(rows, key):
        return identity.normalize_contacts(spark.createDataFrame(rows, SCHEMA.format(key)))

    pos, app = _crowd(5)
    pos, app = pos[:60], [(*r[:3], p[3] and p[3].replace("@p", "@a"), "111" + r[4][3:]) for r, p in zip(app, pos[:50])]

    def local(r): return (r[3] or "").split("@")[0]
    for twice in ([], [(*pos[0][:3], None, "1110000009"), (*pos[0][:3], "m1@p.x", None)]):
        got = [(r.member_id, r.app_member_id) for r in identity.fuzzy_candidates(frame(pos + twice, "member_id"), frame(app, "app_member_id")).collect()]
        want = {(p[0], a[0]) for p in pos + twice for a in app if _similar(p[2], a[2]) >= 0.85 and (
            p[3] and a[3] and local(p) == local(a) or p[4] and a[4] and p[4][:3] == a[4][:3])}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("rounds", [0, 8])
def test_blocks_that_share_records(spark, monkeypatch, rounds):
    """Settled in clusters, and block by block with blocks telling each other, with the same result."""
    monkeypatch.setattr(identity, "CLUSTER_ROUNDS", rounds)
    pos, app = _crowd(8)
    app = [(*r[:3], r[3] and r[3].replace("@a", "@b"), None if i % 3 else r[4]) for i, r in enumerate(app)]
    got = _matched(spark, pos, app)
    assert got == brute_force(pos, app) and len(got) > 40
