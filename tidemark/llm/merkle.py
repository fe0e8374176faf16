"""Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources.

Leaves are dealt over blocks of ``FANOUT`` ** ``LEVELS`` neighbours, and each block hashes its own subtree.
Above that, blocks exchange subtree roots as a butterfly: in round r the ``FANOUT`` blocks of an aligned
group that differ in digit r alone swap the roots they hold, and each of them hashes the common ancestor
for itself. After the last round every block knows the tree's root and the siblings on its way up; nothing
is sent down again. A tree whose number of blocks is no power of the fanout is filled up with empty
blocks, which take part in the exchange, so that no block has more partners than the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.skew import join_by_key
from tidemark.session import checkpointed

FANOUT, LEVELS = 3, 6
# More rounds than any table needs.
MOST_ROUNDS = 40
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place:int,siblings:array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: each ``-`` if null, else the count of its UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    def step(node: Column, run: Column) -> Column:
        siblings, place = run["siblings"], run["place"]
        return F.sha2(F.concat(
            F.array_join(F.slice(siblings, F.lit(1), place), ""), node,
            F.array_join(F.slice(siblings, place + 1, F.lit(FANOUT)), "")), 256)

    return F.aggregate(proof, leaf, step)


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda run: run["siblings"])), ""), 256)


def placed_rows(rows: DataFrame, tree: str, order: list[str], levels: int) -> DataFrame:
    """``rows`` with ``at`` (their place in their tree by ``order``, from 0), ``total`` and ``block``.

    Rows are sorted over all partitions; a tree's rows in the partitions before give the offset, so a tree
    that holds most rows is spread like any other.
    """
    sorted_rows = checkpointed(
        rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
        .withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each tree in a partition.
    starts = sorted_rows.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.partitionBy(tree)).alias("total"))
    return sorted_rows.join(starts, [tree, "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop(
        "_row", "_part", "_shift").withColumn("block", F.floor(F.col("at") / F.lit(FANOUT ** levels)))


def subtree(leaves: list[str], total: int, levels: int) -> list[list[str]]:
    """The levels of a block's subtree, its leaves first; a block that is its whole tree ends at one node."""
    out = [leaves]
    while len(out) <= levels and (total > FANOUT ** levels or len(out[-1]) > 1):
        last = out[-1]
        out.append([digest(last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _by_block(of_block):
    """Runs ``of_block`` on the rows of each (tree, block), which come one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:2] != row[:2]:
                    out += of_block(held)
                    held = []
                held.append(row)
            yield of_block.batch(out)
        yield of_block.batch(of_block(held) if held else [])

    return run


class _Roots:
    """(tree, block, total, node) of a block's leaves."""

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("node", pa.string())])

    def __init__(self, levels: int):
        self.levels = levels

    def __call__(self, rows):
        tree, block, total = rows[0][0], rows[0][1], rows[0][2]
        return [(tree, block, total, subtree([r[3] for r in rows], total, self.levels)[-1][0])]

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)


def butterfly(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, block, root, path, total): the root of each block's tree and its proof from the block's root up.

    ``blocks`` has (tree, block, total, node). Every round is one shuffle of at most ``FANOUT`` short rows
    per block.
    """
    count = F.ceil(F.col("total") / F.lit(FANOUT ** levels))
    rounds = F.size(F.filter(F.array(*(F.lit(FANOUT ** k) for k in range(MOST_ROUNDS - 1))), lambda p: p < F.col("count")))
    real = checkpointed(blocks.withColumn("count", count).withColumn("rounds", rounds).select(
        "tree", "block", "node", "total", "count", "rounds", F.lit(None).cast(PROOF).alias("path")))
    most = real.agg(F.max("rounds")).first()[0] or 0
    # Block b also stands for the empty blocks b + count and b + 2 count, as far as the filled-up tree goes.
    full = F.pow(F.lit(float(FANOUT)), F.col("rounds")).cast("long")
    empty = real.withColumn("block", F.explode(F.array(*(F.col("block") + n * F.col("count") for n in range(1, FANOUT)))))
    state = real.unionByName(empty.filter(F.col("block") < full).withColumn("node", F.lit(None).cast("string")))
    for r in range(most):
        stride = FANOUT ** r
        digit = F.pmod(F.floor(F.col("block") / F.lit(stride)), F.lit(FANOUT)).cast("int")
        to = F.when(F.col("rounds") > r, F.sequence(F.lit(0), F.lit(FANOUT - 1))).otherwise(F.array("digit"))
        sent = state.withColumn("digit", digit).withColumn("to", F.explode(to)).withColumn("own", F.col("to") == F.col("digit"))
        got = sent.groupBy("tree", (F.col("block") + (F.col("to") - F.col("digit")) * stride).alias("block")).agg(
            *(F.max(F.when(F.col("digit") == d, F.col("node"))).alias(f"node{d}") for d in range(FANOUT)),
            F.max(F.when(F.col("own"), F.col("digit"))).alias("digit"),
            F.max("total").alias("total"), F.max("count").alias("count"), F.max("rounds").alias("rounds"),
            F.first(F.when(F.col("own"), F.col("path")), ignorenulls=True).alias("path"))
        nodes = [F.col(f"node{d}") for d in range(FANOUT)]
        more = F.col("rounds") > r
        step = F.struct(F.col("digit").alias("place"), F.array_compact(F.array(*(
            F.when(F.col("digit") != d, n) for d, n in enumerate(nodes)))).alias("siblings"))
        state = got.select(
            "tree", "block", "total", "count", "rounds",
            F.when(~more | F.coalesce(*nodes).isNull(), F.coalesce(*nodes)).otherwise(
                F.sha2(F.concat_ws("", *nodes), 256)).alias("node"),
            F.when(more, F.concat(F.coalesce("path", F.array().cast(PROOF)), F.array(step))).otherwise(F.col("path")).alias("path"))
    return state.filter(F.col("block") < F.col("count")).select(
        "tree", "block", F.col("node").alias("root"), F.coalesce("path", F.array().cast(PROOF)).alias("path"), "total")


class _Proofs:
    """A row for each leaf of a block, whose first row has the block's way up and no leaf."""

    def __init__(self, schema: pa.Schema, kept: int, levels: int):
        self.schema, self.kept, self.levels = schema, kept, levels

    def __call__(self, rows):
        (*_, above), leaves = rows[0], rows[1:]
        total, start = leaves[0][3], leaves[0][4]
        nodes = subtree([r[5] for r in leaves], total, self.levels)
        out = []
        for i, row in enumerate(leaves):
            proof, n = [], i
            for level in nodes[:-1]:
                first, place = n - n % FANOUT, n % FANOUT
                run = level[first:first + FANOUT]
                proof.append({"place": place, "siblings": run[:place] + run[place + 1:]})
                n //= FANOUT
            out.append((row[0], start + i, row[5], above["root"], above["top"], proof + above["path"], *row[6:6 + self.kept]))
        return out

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)


def climbed(rows: DataFrame, kept: list[str], order: list[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """The rows of (tree, leaf, …) with their places, and (tree, block, root, path, total) of their blocks."""
    placed = placed_rows(rows.select("tree", "leaf", *kept), "tree", order, levels)
    spread = placed.select("tree", "block", "total", "leaf", "at").repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    roots = spread.select("tree", "block", "total", "leaf").mapInArrow(_by_block(_Roots(levels)), "tree string, block long, total long, node string")
    return placed, checkpointed(butterfly(roots, levels))


def tree_proofs(placed: DataFrame, up: DataFrame, kept: list[tuple[str, str]], levels: int) -> DataFrame:
    """(tree, at, leaf, root, top, proof, and the ``kept`` columns) of each placed row.

    ``up`` has (tree, block, root, top, path) of the blocks. ``kept`` has names and types: long or string.
    """
    names = [n for n, _ in kept]
    head = up.select(
        "tree", "block", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (
            ("total", "long"), ("at", "long"), ("leaf", "string"), *kept)), F.struct("root", "top", "path").alias("above"))
    body = placed.select(
        "tree", "block", F.lit(1).alias("kind"), "total", "at", "leaf", *names,
        F.lit(None).cast(f"struct<root:string,top:string,path:{PROOF}>").alias("above"))
    kinds = {"long": pa.int64(), "string": pa.string()}
    proof = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
    schema = pa.schema([
        ("tree", pa.string()), ("at", pa.int64()), ("leaf", pa.string()), ("root", pa.string()), ("top", pa.string()),
        ("proof", proof), *((n, kinds[t]) for n, t in kept)])
    return head.unionByName(body).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at").mapInArrow(
        _by_block(_Proofs(schema, len(kept), levels)),
        f"tree string, at long, leaf string, root string, top string, proof {PROOF}" + "".join(f", {n} {t}" for n, t in kept))


def manifest(leaves: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, and ``seen``) of each row of (doc_id, source, leaf, seen).

    ``leaf`` is a digest in hex (``leaf_digest``); ``seen`` is carried along, for instance the digest of the row as it is
    found later. ``proof`` has for each run on the way to the root the row's place in it and the digests of the
    others. A source's leaves ascend by doc_id (null ones first, ties by leaf); while it has several nodes, each
    run of ``FANOUT`` neighbours (fewer at the end, even one) becomes their hash. Sources ascend by their UTF-8
    bytes, the null source first, and make a tree in the same way. Repeated rows are leaves of their own. An
    empty table has no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = checkpointed(leaves.select(key.alias("tree"), "leaf", F.col("doc_id").cast("long"), F.col("seen").cast("string")))
    inner, up = climbed(rows, ["doc_id", "seen"], ["doc_id", "leaf", "seen"], levels)
    sources = up.filter("block = 0").select(
        F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("name"),
        F.ceil(F.col("total") / F.lit(FANOUT ** levels)).alias("blocks"))
    outer, over = climbed(sources, ["name", "blocks"], ["name"], levels)
    tops = checkpointed(tree_proofs(outer, over.withColumn("top", F.col("root")), [("name", "string"), ("blocks", "long")], levels).select(
        F.col("name").alias("tree"), "top", F.col("proof").alias("above"), "blocks"))
    whole = join_by_key(up, tops, ["tree"], F.col("block"), sizes="blocks").withColumn("path", F.concat("path", "above"))
    return tree_proofs(inner, whole, [("doc_id", "long"), ("seen", "string")], levels).select(
        "doc_id", F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source"), "leaf",
        F.col("root").alias("subroot"), F.col("top").alias("root"), "proof", "seen")


def verified(docs: DataFrame, seen_text: Column, *, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    The manifest is of ``docs`` as they are; each row is then checked with ``seen_text`` in place of its text:
    its digest is folded with the manifest's siblings, and is verified if that gives the root. ``docs``
    needs the columns in ``FIELDS``; others are not read. Null fields count as ``-``.
    """
    rows = docs.select(*FIELDS, seen_text.alias("_seen"))
    leaves = rows.select(
        "doc_id", "source", leaf_digest(*(F.col(c) for c in FIELDS)).alias("leaf"),
        leaf_digest(*(F.col(c) for c in FIELDS[:-1]), F.col("_seen")).alias("seen"))
    return manifest(leaves, levels=levels).select(
        "doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("seen"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
