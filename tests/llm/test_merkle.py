"""The Merkle manifest against trees hashed level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, block long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*fields):
    return _h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _way(levels, at):
    for level in levels[:-1]:
        first = at - at % 3
        yield at % 3, level[first:at] + level[at + 1:first + 3]
        at //= 3


def brute_force(rows, seen):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        leaves = sorted(((r[0], _leaf(*r[:5]), _leaf(*r[:4], seen(r))) for r in by_source[s]),
                        key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, _levels([x[1] for x in leaves])))
    top = _levels([levels[-1][0] for _, levels in trees])
    out = []
    for n, (leaves, levels) in enumerate(trees):
        for at, (doc_id, leaf, found) in enumerate(leaves):
            proof = [*_way(levels, at), *_way(top, n)]
            node = found
            for place, others in proof:
                node = _h(*others[:place], node, *others[place:])
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], _h(*(x for _, o in proof for x in o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def _rows(rng, n, sources):
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["a\nb", "plain", "", None, "é\n" * 3]))
            for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("sizes", [(1, 1), (29, 1), (400, 12)])
def test_manifest(spark, levels, sizes):
    rng = random.Random(sizes[0])
    # One source has most rows; the others differ in bytes only, one is null, one is empty.
    rows = _rows(rng, sizes[0], ["big"]) + _rows(rng, 5 * sizes[1], ["é", "z", "Z", None, "", "big"])[:sizes[1] * 5 - 4]
    rows += [rows[0], (None, "big", None, None, None), (None, "big", None, 1, "x\n")]
    df = spark.createDataFrame([(*r, "t", "l", 3) for r in rows], SCHEMA).repartition(5)
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = _got(merkle.verified(df, F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), levels=levels))

    def seen(r):
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return r[4].replace("\n", "") if even and r[4] else r[4]

    assert got == brute_force(rows, seen)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(empty, F.col("text")).count() == 0
    rows = [(1, "s", "en", 5, "line\n" * 200_000)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert _got(merkle.verified(df, F.col("text"))) == brute_force(rows, lambda r: r[4])


def test_any_changed_field_is_found(spark):
    rows = [(i, f"s{i % 2}", "en", 4, f"text {i}") for i in range(20)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    lost = {r.doc_id for r in merkle.verified(df, F.when(F.col("doc_id") == 7, F.lit("text 8")).otherwise(F.col("text")), levels=1)
            .collect() if not r.verified}
    assert lost == {7}
