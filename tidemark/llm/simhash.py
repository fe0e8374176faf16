"""Near-duplicate groups by SimHash: fingerprints, pigeonhole blocks, Hamming check, components.

Texts with the same fingerprint are one point from the start, so copies are never paired. A
fingerprint is cut into six blocks; two fingerprints that differ in at most four bits agree on at
least two whole blocks, so each pair of blocks gives one key to meet on. Who meets is checked by
Hamming distance, and the links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shingles import similar_groups
from tidemark.llm.skew import join_by_key, packed
from tidemark.session import checkpointed

SHINGLE_WORDS, SEED, MAX_DISTANCE = 4, 42, 4
# Groups up to this size are compared pair by pair in one vector step.
SMALL = 16
BIT_ROWS = 1 << 15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of the shingle hashes, as a signed 64-bit integer; no words give 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        bits = np.unpackbits(hashes[at:at + BIT_ROWS].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, print) for every row; A-Z is lower-cased, words are split at ASCII white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, print long")


def block_masks() -> list[int]:
    """A mask for each way to pick two of six blocks, as signed 64-bit integers."""
    blocks, at = [], 0
    for width in (11, 11, 11, 11, 10, 10):
        blocks.append(((1 << width) - 1) << at)
        at += width
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as numpy counts the bits of an absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spread_links(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join a large group's components: each step compares only with what is not yet reached."""
    rest = np.arange(len(prints))
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = np.array([root])
        while len(frontier) and len(rest):
            step = max(1, (1 << 20) // len(rest))
            block, frontier = frontier[:step], frontier[step:]
            near = (_apart(prints[block][:, None], prints[rest][None, :]) <= distance).any(axis=0)
            found, rest = rest[near], rest[~near]
            yield from ((prints[root], prints[x]) for x in found)
            frontier = np.concatenate((frontier, found))


def _group_links(group: np.ndarray, prints: np.ndarray, distance: int) -> tuple[list, list]:
    """Links inside groups of adjacent rows; ``group`` numbers the groups in order."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, len(group))):
        near = (group[lag:] == group[:-lag]) & small[lag:]
        at = np.flatnonzero(near)
        at = at[_apart(prints[at], prints[at + lag]) <= distance]
        left.extend(prints[at].tolist())
        right.extend(prints[at + lag].tolist())
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for a, b in _spread_links(prints[start:start + size], distance):
            left.append(int(a))
            right.append(int(b))
    return left, right


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def out(columns, upto):
            ways, keys, prints = (c[:upto] for c in columns)
            if len(prints) < 2:
                return None
            changes = (ways[1:] != ways[:-1]) | (keys[1:] != keys[:-1])
            links = _group_links(np.concatenate(([0], np.cumsum(changes))), prints, distance)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

        for batch in batches:
            kept = [np.concatenate((k, c.to_numpy(zero_copy_only=False).astype(np.int64))) for k, c in zip(kept, batch.columns)]
            ways, keys, _ = kept
            if not len(ways):
                continue
            same = (ways == ways[-1]) & (keys == keys[-1])
            open_from = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if (found := out(kept, open_from)) is not None:
                yield found
            kept = [c[open_from:] for c in kept]
        if (found := out(kept, len(kept[0]))) is not None:
            yield found

    return run


def links(points: DataFrame, *, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) links between the distinct ``print`` values that differ in at most ``distance`` bits.

    Groups over ``SMALL`` give links that connect the same components, not every pair.
    """
    if distance > MAX_DISTANCE:
        raise ValueError(f"six blocks find up to {MAX_DISTANCE} differing bits")
    ways = F.array(*(
        F.struct(F.lit(n).alias("way"), F.col("print").bitwiseAND(F.lit(m)).alias("key"))
        for n, m in enumerate(block_masks())))
    met = points.select("print", F.inline(ways)).select("way", "key", "print")
    return (
        met.repartition("way", "key").sortWithinPartitions("way", "key")
        .mapInArrow(_links(distance), "a long, b long").filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected (a, b) edges; root is the component's smallest node.

    Each round hooks a node's larger neighbours to its smallest one and then its smaller neighbours
    too, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    def smallest(of: DataFrame) -> DataFrame:
        # Materialised, so that the join is between two shuffles, of which adaptive execution splits a large node's part.
        least = checkpointed(of.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return of.join(least, "u")

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), None
    while mark != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(
            smallest(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())
        small = smallest(large)
        edges = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())
        before, mark = mark, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_groups(docs: DataFrame, *, distance: int = MAX_DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all documents reachable by links, a document itself
    included; null ids are passed over (null if a component has no other). Texts without words,
    null ones too, have fingerprint zero and are linked like any other. Repeated rows stay repeated.
    """
    rows = checkpointed(fingerprints(docs, words))
    points = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(points, distance=distance)).withColumnRenamed("node", "print")
    rooted = points.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "first")
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = join_by_key(rooted, least, ["root"], F.col("print")).select("print", "component_id")
    return join_by_key(rows, of_print, ["print"], F.col("doc_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, *, distance: int = MAX_DISTANCE, words: int = SHINGLE_WORDS,
                     similarity: float | None = None) -> DataFrame:
    """``docs``, all its columns, with one document of each component: the one with the smallest doc_id.

    With ``similarity`` the links are the pairs of at least that Jaccard similarity of shingles of ``words``
    words, all of them (``shingles.similar_groups``); without it those of ``near_groups``.

    Rows without a doc_id stay only if their whole component has none (all of them then). Of repeated
    rows with one doc_id one stays.
    """
    if similarity is None:
        groups = near_groups(docs, distance=distance, words=words)
    else:
        groups = similar_groups(docs, words=words, similarity=similarity)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    named = packed(docs, _doc=F.col("doc_id")).join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    with_id = named.filter(F.col("_doc").isNotNull()).dropDuplicates(["_doc"])
    return with_id.unionByName(named.filter(F.col("_doc").isNull())).select("_row.*")
