"""Exact top-k inner products through a pivot-distance index.

Vectors get one more component that brings all of them to the same length, so that the largest
inner product belongs to the nearest vector. Each vector is keyed by its nearest pivot and its
distance to it; a pivot's vectors are cut by distance into annuli. A query first visits the annuli
around its own distance to its nearest pivot, as many as hold enough vectors. The score it reaches
there gives a radius, and by the triangle inequality an annulus that lies farther from the query's
distance to that pivot than the radius holds nothing better and is not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.carry import carried
from tidemark.llm.skew import join_by_key
from tidemark.session import checkpointed

PIVOTS, ANNULI = 32, 64
# Rows of the sample the pivots are picked from; rows of an annulus, and of a lot of a large one.
SAMPLE_ROWS, ANNULUS_ROWS, LOT_ROWS = 4096, 2048, 4096
SCALE = 256


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): components floor(256 x); vectors null or with null or non-finite components are left out.

    Shorter vectors count as ending in zeros.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each as far as possible from those before it."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _lifted(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the component that brings their squared length to ``square``."""
    rest = np.sqrt(np.maximum(square - (v * v).sum(axis=1), 0.0))
    return np.concatenate((v, rest[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


class Index:
    """What every task needs to know of the index: pivots and annuli, both of bounded number."""

    def __init__(self, width: int, square: float, pivots: np.ndarray, annuli: list):
        self.width, self.square, self.pivots = width, square, pivots
        self.slack = 1e-6 * (1.0 + float(np.sqrt(square)))
        self.annuli = annuli  # (pivot, annulus, rows, lots, low, high)

    def routes(self, queries: np.ndarray, ids: np.ndarray, wanted: int) -> Iterator[tuple[int, int, int, int]]:
        """(query row, pivot, annulus, lots) of the first visit: outwards until enough vectors are met."""
        away = _distances(np.concatenate((queries, np.zeros((len(queries), 1))), axis=1), self.pivots)
        for row in range(len(queries)):
            met = 0
            nearest = sorted(self.annuli, key=lambda a: (away[row, a[0]] if a[0] >= 0 else 0, max(a[4] - away[row, a[0]], away[row, a[0]] - a[5], 0.0)))
            for pivot, annulus, rows, lots, _, _ in nearest:
                yield row, pivot, annulus, lots
                met += rows
                if met >= wanted:
                    break

    def rest(self, queries: np.ndarray, scores: list, wanted: int, seen: list[set]) -> Iterator[tuple[int, int, int, int]]:
        """What is still to be visited, given the score each query has reached (None: not enough vectors)."""
        away = _distances(np.concatenate((queries, np.zeros((len(queries), 1))), axis=1), self.pivots)
        norms = (queries * queries).sum(axis=1)
        for row in range(len(queries)):
            radius = np.inf if scores[row] is None else np.sqrt(max(norms[row] + self.square - 2.0 * scores[row], 0.0)) + self.slack
            for pivot, annulus, _, lots, low, high in self.annuli:
                d = away[row, pivot]
                if low - radius <= d <= high + radius and (pivot, annulus) not in seen[row]:
                    yield row, pivot, annulus, lots


def build_index(vectors: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index and its rows (pivot, annulus, lot, vec_id, v); None without vectors."""
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    width, longest = vectors.agg(F.max(F.size("v")), F.max(square)).first()
    if width is None:
        return None
    width = max(width, 1)
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()
    base = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        base[i, :len(r["v"])] = r["v"]
    pivots = pick_pivots(_lifted(base, longest), PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_lifted(_matrix(batch.column(1), width), longest), pivots)
            near = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])],
                ["vec_id", "v", "pivot", "distance"])

    padded = vectors.select("vec_id", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))).alias("v"))
    keyed = checkpointed(padded.mapInArrow(key, "vec_id long, v array<bigint>, pivot int, distance double"))
    cuts = [i / ANNULI for i in range(1, ANNULI)]
    bounds = []
    for r in keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", cuts, 10_000).alias("cuts")).collect():
        step = max(1, ANNULI // max(1, -(-r["n"] // ANNULUS_ROWS)))
        bounds.append((r["pivot"], sorted(set(r["cuts"][step - 1::step]))))
    cut_table = vectors.sparkSession.createDataFrame(bounds, "pivot int, bounds array<double>")
    ringed = keyed.join(F.broadcast(cut_table), "pivot").withColumn(
        "annulus", F.size(F.filter("bounds", lambda b: b < F.col("distance")))).drop("bounds")
    directory = [
        (r["pivot"], r["annulus"], r["n"], -(-r["n"] // LOT_ROWS), r["low"], r["high"]) for r in
        ringed.groupBy("pivot", "annulus").agg(
            F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()]
    lots = vectors.sparkSession.createDataFrame([(a[0], a[1], a[3]) for a in directory], "pivot int, annulus int, lots int")
    rows = ringed.join(F.broadcast(lots), ["pivot", "annulus"]).select(
        "pivot", "annulus", F.pmod(F.xxhash64("vec_id"), F.col("lots")).cast("int").alias("lot"), "vec_id", "v")
    return Index(width, longest, pivots, directory), rows


def _scan(width: int, wanted: int):
    """Best ``wanted`` candidates of each query in each lot; a lot's candidates come before its queries."""
    def best(q_ids, q, c_ids, c, out):
        if not len(q_ids) or not len(c_ids):
            return
        exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * width < 2 ** 52
        for at in range(0, len(q), 256):
            part = q[at:at + 256]
            scores = (part @ c.T).astype(np.int64) if exact else part.astype(np.int64) @ c.astype(np.int64).T
            for i, row in enumerate(scores):
                if len(row) > wanted:  # all that tie with the last place, then the smaller ids
                    last = np.partition(row, len(row) - wanted)[len(row) - wanted]
                    took = np.flatnonzero(row >= last)
                else:
                    took = np.arange(len(row))
                took = took[np.lexsort((c_ids[took], -row[took]))][:wanted]
                out[0].extend([q_ids[at + i]] * len(took))
                out[1].extend(c_ids[took].tolist())
                out[2].extend(row[took].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held_ids, held = None, np.empty(0, np.int64), np.empty((0, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            query, ids, v = batch.column(3).to_numpy(zero_copy_only=False).astype(bool), batch.column(4).to_numpy(), _matrix(batch.column(5), width)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if tuple(keys[a]) != lot:
                    lot, held_ids, held = tuple(keys[a]), ids[:0], v[:0]
                own = ~query[a:b]
                held_ids, held = np.concatenate((held_ids, ids[a:b][own])), np.concatenate((held, v[a:b][own]))
                best(ids[a:b][~own], v[a:b][~own], held_ids, held, out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query", "vec_id", "score"])

    return run


def _visit(rows: DataFrame, routes: DataFrame, width: int, wanted: int) -> DataFrame:
    both = rows.select("pivot", "annulus", "lot", F.lit(False).alias("is_query"), "vec_id", "v").unionByName(
        routes.select("pivot", "annulus", "lot", F.lit(True).alias("is_query"), F.col("query").alias("vec_id"), "v"))
    found = both.repartition("pivot", "annulus", "lot").sortWithinPartitions("pivot", "annulus", "lot", "is_query").mapInArrow(
        _scan(width, wanted), "query long, vec_id long, score long")
    return _top(found, "query", wanted)


def _top(found: DataFrame, key: str, wanted: int) -> DataFrame:
    best = W.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted)


_ROUTES = "query long, v array<bigint>, pivot int, annulus int, lots int"


def _routed(pieces, ids, queries, v_column) -> pa.RecordBatch:
    pieces = list(pieces)
    row = np.array([p[0] for p in pieces], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row], pa.int64()), v_column.take(pa.array(row)),
         *(pa.array(np.array([p[i] for p in pieces], np.int32)) for i in (1, 2, 3))],
        ["query", "v", "pivot", "annulus", "lots"])


def _by_lot(routes: DataFrame) -> DataFrame:
    return routes.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))


def top_inner_products(rows: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` largest integer inner products.

    Queries are the rows whose vec_id is a multiple of ``every``; candidates are all other rows. Ties
    go to the smaller vec_id; with fewer than ``k`` candidates all are given. Equal vectors are
    indexed and searched once: of each, the ``k`` + 1 smallest ids can be in a result. A vec_id that
    occurs several times takes part with each of its vectors (equal ones once). ``rows`` needs vec_id and
    embedding; other columns are not read.
    """
    spark, wanted = rows.sparkSession, k + 1
    vectors = checkpointed(whole_vectors(rows).distinct())
    same = W.partitionBy("v").orderBy("vec_id")
    built = build_index(vectors.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= wanted).drop("place"))
    schema = "query_id long, rank int, vec_id long, score long"
    if built is None:
        return spark.createDataFrame([], schema)
    index, indexed = built
    width = index.width
    shared = carried(spark, (index.width, index.square, index.pivots, index.annuli), lambda plain: Index(*plain))
    asked = vectors.filter(F.col("vec_id") % every == 0)
    members = asked.select("vec_id", "v")
    leaders = checkpointed(members.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))).alias("v"), F.col("v").alias("key")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            yield _routed(shared().routes(q, ids, wanted), ids, q, batch.column(1))

    first_routes = checkpointed(leaders.select("query", "v").mapInArrow(first, _ROUTES))
    reached = checkpointed(_visit(indexed, _by_lot(first_routes), width, wanted).drop("rank"))
    visited = first_routes.groupBy("query").agg(F.collect_list(F.struct("pivot", "annulus")).alias("seen"))
    state = reached.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            seen = [{(s["pivot"], s["annulus"]) for s in (x or [])} for x in batch.column(2).to_pylist()]
            scores = [s if n == wanted else None for n, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield _routed(shared().rest(q, scores, wanted, seen), ids, q, batch.column(1))

    next_routes = leaders.select("query", "v").join(visited, "query", "left").join(state, "query", "left").mapInArrow(more, _ROUTES)
    found = reached.unionByName(_visit(indexed, _by_lot(next_routes), width, wanted).drop("rank"))
    best = checkpointed(_top(found, "query", wanted).select("query", "vec_id", "score"))
    results = best.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))
    of_member = join_by_key(
        members.withColumn("key", F.xxhash64("v")).withColumnRenamed("vec_id", "query_id"),
        leaders.withColumn("hash", F.xxhash64("key")).select(F.col("hash").alias("key"), F.col("key").alias("leader"), "query")
        .join(results, "query").groupBy("key").agg(F.collect_list(F.struct("leader", "best")).alias("found")),
        ["key"], F.col("query_id"),
    ).select("query_id", F.inline(F.filter("found", lambda f: f["leader"] == F.col("v")))).select("query_id", F.inline("best"))
    return _top(of_member.filter("vec_id <> query_id").distinct(), "query_id", k).select("query_id", "rank", "vec_id", "score")
