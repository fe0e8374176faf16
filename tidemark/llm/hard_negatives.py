"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. For two vectors the angles to one reference
bound the angle between them from both sides, by the triangle inequality on the sphere; the tightest
bounds over all references, times the two lengths, bound the inner product. Vectors are kept in cells (nearest
reference, range of the angle to it) and inside a cell in windows of neighbours with one label, for which the
ranges of angles and lengths are known. An anchor goes to the cells, and there to the windows, whose bounds
overlap the scores it still needs; only those are scored, on whole numbers. Bounds are widened by more than all
rounding, so nothing is lost. What an anchor needs is first narrowed by the best it finds in a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import checkpointed

REFERENCES, RANGES = 16, 16
# Rows of a cell (as far as there are rows for that), components of a lot of a cell, rows of a window.
CELL_ROWS, LOT_COMPONENTS, WINDOW_ROWS = 2048, 1 << 21, 128
# Rows and components of the sample that gives references and first scores; it is broadcast.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 4096, 1 << 19
SCALE = 256
# Radians: more than the rounding of stored angles (32 bits) and of arc cosines near 0 and pi.
SLACK = 1e-5
ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): components floor(256 x) of rows with an id, a label and only finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.filter(known & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def spread_directions(unit: np.ndarray, count: int) -> np.ndarray:
    """Rows of unit vectors, each as far as possible in angle from those before it."""
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)) and nearest.min() < 1.0 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def lengths_and_angles(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector and its angle to each reference; a zero vector is at a right angle to all."""
    v = v.astype(np.float64)
    length = np.sqrt((v * v).sum(axis=1))
    cosine = (v @ references.T) / np.where(length > 0, length, 1.0)[:, None]
    return length, np.arccos(np.clip(cosine, -1.0, 1.0))


def score_bounds(length: np.ndarray, angles: np.ndarray, of: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each vector with anything in each of the regions ``of``.

    Regions have arrays near and far (smallest and largest angle to each reference), short and long (lengths).
    """
    least = np.zeros((len(angles), len(of["near"])))
    most = np.full(least.shape, np.pi)
    for r in range(angles.shape[1]):
        own, near, far = angles[:, r, None], of["near"][None, :, r], of["far"][None, :, r]
        np.maximum(least, np.maximum(near - own, own - far), out=least)
        np.minimum(most, np.minimum(own + far, 2 * np.pi - own - near), out=most)
    high, low = np.cos(np.clip(least - SLACK, 0.0, np.pi)), np.cos(np.clip(most + SLACK, 0.0, np.pi))
    short, long = length[:, None] * of["short"][None, :], length[:, None] * of["long"][None, :]
    room = 1.0 + 1e-9 * long
    return np.minimum(low * short, low * long) - room, np.maximum(high * short, high * long) + room


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by floating point where every step of that is exact."""
    size = max(float(np.abs(a.astype(np.float64)).max(initial=1)), 1.0) * max(float(np.abs(b.astype(np.float64)).max(initial=1)), 1.0)
    if size * a.shape[1] < 2 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_in_ranges(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int):
    """(range, row) of the first ``wanted`` rows of each owner in each of its ranges of scores.

    ``low`` and ``high`` have a row for each owner. Higher scores come first, then smaller ids.
    """
    order = np.lexsort((ids, -score, owner))
    owner, score = owner[order], score[order]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for j in range(low.shape[1]):
        inside = np.flatnonzero((score >= low[owner, j]) & (score <= high[owner, j]))
        at = owner[inside]
        first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.empty(0, bool)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        kept = inside[place < wanted]
        found.append((np.full(len(kept), j, np.int64), order[kept]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Lot:
    """Rows of one cell, in windows of one label and neighbouring angles to the cell's reference."""

    def __init__(self, ids, labels, v, length, angles, reference):
        order = np.lexsort((ids, angles[:, reference], labels))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        length, angles = length[order], angles[order].astype(np.float64)
        new = np.flatnonzero(np.concatenate(([True], self.labels[1:] != self.labels[:-1])))
        ends = np.concatenate((new[1:], [len(order)]))
        self.starts = np.concatenate([np.arange(a, b, WINDOW_ROWS) for a, b in zip(new.tolist(), ends.tolist())])
        self.ends = np.concatenate((self.starts[1:], [len(order)]))
        self.window_labels = self.labels[self.starts]
        self.windows = {
            "near": np.minimum.reduceat(angles, self.starts), "far": np.maximum.reduceat(angles, self.starts),
            "short": np.minimum.reduceat(length, self.starts), "long": np.maximum.reduceat(length, self.starts)}

    def found(self, anchors: dict, same_label: bool, wanted: int) -> list[tuple[np.ndarray, ...]]:
        """(anchor row, range, vec_id, score) of the first ``wanted`` rows in each anchor's ranges of scores."""
        out = []
        for at in range(0, len(anchors["ids"]), ANCHORS_AT_ONCE):
            a = {k: x[at:at + ANCHORS_AT_ONCE] for k, x in anchors.items()}
            low, high = score_bounds(a["length"], a["angles"], self.windows)
            needed = np.zeros(low.shape, bool)
            for j in range(a["low"].shape[1]):
                needed |= (high >= a["low"][:, j, None]) & (low <= a["high"][:, j, None])
            needed &= (a["labels"][:, None] == self.window_labels[None, :]) == same_label
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def reduced():
                owner, ids, score = (np.concatenate(x) for x in zip(*held))
                place, row = best_in_ranges(owner, ids, score, a["low"], a["high"], wanted)
                return owner[row], place, ids[row], score[row]

            for w in np.flatnonzero(needed.any(axis=0)).tolist():
                rows = np.flatnonzero(needed[:, w])
                part = slice(self.starts[w], self.ends[w])
                score = exact_scores(a["v"][rows], self.v[part])
                ids = self.ids[part]
                usable = (score >= a["low"][rows].min(axis=1)[:, None]) & (score <= a["high"][rows].max(axis=1)[:, None])
                usable &= ids[None, :] != a["ids"][rows][:, None]
                i, c = np.nonzero(usable)
                if len(i):
                    held.append((rows[i], ids[c], score[i, c]))
                    size += len(i)
                if size > PAIRS_AT_ONCE:
                    # Rows that are first in some range are enough; a row may be first in several.
                    owner, _, ids, score = reduced()
                    row = np.unique(np.stack((owner, ids, score)), axis=1)
                    held, size = [tuple(row)], row.shape[1]
            if held:
                owner, place, ids, score = reduced()
                out.append((owner + at, place, ids, score))
        return out


_ROWS = "vec_id long, label long, v binary, length double, angles array<float>, reference int, angle double"


class Index:
    """What the driver knows of the index: settings, references, cells and the sample, all of bounded size."""

    def __init__(self, vectors: DataFrame, wanted: int):
        largest = F.max(F.array_max(F.transform("v", lambda e: F.abs(e))))
        stats = vectors.agg(F.max(F.size("v")).alias("width"), largest.alias("largest")).first()
        self.width = max(stats["width"] or 0, 1)
        big = stats["largest"] or 0
        self.kind = "<i2" if big < 1 << 15 else "<i4" if big < 1 << 31 else "<i8"
        picked = vectors.orderBy(F.xxhash64("v", "vec_id"), "vec_id", "label", "v").limit(
            max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // self.width))).collect()
        base = np.zeros((len(picked), self.width), np.int64)
        for i, r in enumerate(picked):
            base[i, :len(r["v"])] = r["v"]
        self.sample = (np.array([r["vec_id"] for r in picked], np.int64), np.array([r["label"] for r in picked], np.int64), base.astype(self.kind))
        length = np.sqrt((base.astype(np.float64) ** 2).sum(axis=1))
        unit = base[length > 0] / length[length > 0][:, None]
        self.references = spread_directions(unit, REFERENCES) if len(unit) else np.eye(1, self.width)
        same = W.partitionBy("label", "v").orderBy("vec_id")
        # Of equal vectors with one label only the smallest ids can be in a result.
        first = vectors.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") <= wanted).drop("_place")
        self.rows, self.cells = self._in_cells(checkpointed(self.measured(first)))

    def measured(self, vectors: DataFrame) -> DataFrame:
        """The vectors packed, with length, angles to all references and the nearest of these."""
        width, kind, references = self.width, self.kind, self.references

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                length, angles = lengths_and_angles(v, references)
                near = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), pa.array(length),
                     pa.array(list(angles.astype(np.float32)), pa.list_(pa.float32())), pa.array(near.astype(np.int32)),
                     pa.array(angles[np.arange(len(near)), near])],
                    ["vec_id", "label", "v", "length", "angles", "reference", "angle"])

        padded = vectors.select("vec_id", "label", F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))).alias("v"))
        return padded.mapInArrow(run, _ROWS)

    def _in_cells(self, rows: DataFrame) -> tuple[DataFrame, dict]:
        """The rows with cell and lot, and for each cell its lots and ranges; at most REFERENCES * RANGES cells."""
        spark, cuts = rows.sparkSession, [i / RANGES for i in range(1, RANGES)]
        bounds = []
        for r in rows.groupBy("reference").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", cuts, 10_000).alias("cuts")).collect():
            step = max(1, RANGES // max(1, -(-r["n"] // CELL_ROWS)))
            bounds.append((r["reference"], sorted(set(r["cuts"][step - 1::step]))))
        table = spark.createDataFrame(bounds, "reference int, bounds array<double>")
        celled = rows.join(F.broadcast(table), "reference").withColumn(
            "cell", F.col("reference") * RANGES + F.size(F.filter("bounds", lambda b: b < F.col("angle")))).drop("bounds", "angle")
        lot_rows = max(WINDOW_ROWS, LOT_COMPONENTS // self.width)
        n = len(self.references)
        found = celled.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("length").alias("short"), F.max("length").alias("long"),
            *(f(F.get("angles", F.lit(i))).alias(f"{name}{i}") for i in range(n) for name, f in (("near", F.min), ("far", F.max)))).collect()
        cells = {
            "cell": np.array([r["cell"] for r in found], np.int32), "lots": np.array([-(-r["n"] // lot_rows) for r in found], np.int32),
            "near": np.array([[r[f"near{i}"] for i in range(n)] for r in found], np.float64).reshape(-1, n),
            "far": np.array([[r[f"far{i}"] for i in range(n)] for r in found], np.float64).reshape(-1, n),
            "short": np.array([r["short"] for r in found]), "long": np.array([r["long"] for r in found])}
        lots = spark.createDataFrame([(int(c), int(k)) for c, k in zip(cells["cell"], cells["lots"])], "cell int, lots int")
        return celled.join(F.broadcast(lots), "cell").withColumn(
            "lot", F.pmod(F.xxhash64("vec_id"), F.col("lots")).cast("int")).drop("lots"), cells

    def search(self, anchors: DataFrame, ranges: Column, *, same_label: bool, wanted: int) -> DataFrame:
        """(anchor, place, vec_id, score): for each anchor and each of its ranges of scores the first ``wanted`` rows.

        ``anchors`` has (anchor, and the columns of the rows); ``ranges`` is an array of (low, high) structs.
        Rows with an anchor's vec_id are passed over.
        """
        width, kind = self.width, self.kind
        shared = anchors.sparkSession.sparkContext.broadcast((self.cells, self.sample))

        def anchor_arrays(batch: pa.RecordBatch, columns: tuple[int, ...]) -> dict:
            ids, labels, v, length, angles, low, high = (batch.column(c) for c in columns)
            longest = max((len(x) for x in low), default=0)

            def padded(column, fill):
                # An empty range stands for a missing one.
                return np.array([x + [fill] * (longest - len(x)) for x in column.to_pylist()], np.int64).reshape(len(column), longest)

            return {"ids": ids.to_numpy(), "labels": labels.to_numpy(), "v": _matrix(v, width, kind), "length": length.to_numpy(),
                    "angles": angles.flatten().to_numpy().reshape(len(angles), -1).astype(np.float64),
                    "low": padded(low, HIGHEST), "high": padded(high, LOWEST)}

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, (ids, labels, v) = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, ANCHORS_AT_ONCE):
                    batch = whole.slice(at, ANCHORS_AT_ONCE)
                    a = anchor_arrays(batch, (1, 2, 3, 4, 5, 6, 7))
                    score = exact_scores(a["v"], v)
                    allowed = ((a["labels"][:, None] == labels[None, :]) == same_label) & (a["ids"][:, None] != ids[None, :])
                    for j in range(a["low"].shape[1]):
                        for i in range(len(score)):
                            row = score[i][allowed[i] & (score[i] >= a["low"][i, j]) & (score[i] <= a["high"][i, j])]
                            if len(row) >= wanted:
                                a["low"][i, j] = np.partition(row, len(row) - wanted)[len(row) - wanted]
                    low, high = score_bounds(a["length"], a["angles"], cells)
                    needed = np.zeros(low.shape, bool)
                    for j in range(a["low"].shape[1]):
                        needed |= (high >= a["low"][:, j, None]) & (low <= a["high"][:, j, None])
                    i, c = np.nonzero(needed)
                    rows = batch.select(list(range(6))).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, *(pa.array(list(a[k][i]), pa.list_(pa.int64())) for k in ("low", "high")),
                         pa.array(cells["cell"][c]), pa.array(cells["lots"][c])],
                        ["anchor", "vec_id", "label", "v", "length", "angles", "low", "high", "cell", "lots"])

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, lot = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                edges = np.flatnonzero(np.concatenate((
                    [True], (cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), [True])))
                out = [(np.empty(0, np.int64),) * 4]
                for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if (cell[begin], number[begin]) != key:
                        key, held, lot = (cell[begin], number[begin]), [], None
                    part = batch.slice(begin, end - begin)
                    if not asks[begin]:
                        held.append(part)
                    elif held:
                        if lot is None:
                            ids, labels, v, length, angles = ([b.column(c) for b in held] for c in (4, 5, 6, 7, 8))
                            lot = Lot(*(np.concatenate([x.to_numpy() for x in y]) for y in (ids, labels)),
                                      np.concatenate([_matrix(x, width, kind) for x in v]), np.concatenate([x.to_numpy() for x in length]),
                                      np.concatenate([x.flatten().to_numpy().reshape(len(x), -1) for x in angles]), key[0] // RANGES)
                        a = anchor_arrays(part, (4, 5, 6, 7, 8, 9, 10))
                        numbers = part.column(3).to_numpy()
                        out += [(numbers[owner], place, ids, score) for owner, place, ids, score in lot.found(a, same_label, wanted)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["anchor", "place", "vec_id", "score"])

        asked = anchors.select(
            "anchor", "vec_id", "label", "v", "length", "angles", F.transform(ranges, lambda r: r["low"]).alias("low"),
            F.transform(ranges, lambda r: r["high"]).alias("high"))
        routes = asked.mapInArrow(
            routed, "anchor long, vec_id long, label long, v binary, length double, angles array<float>, low array<long>, "
            "high array<long>, cell int, lots int").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        names = ["anchor", "vec_id", "label", "v", "length", "angles", "low", "high"]
        none = F.lit(None).cast("array<long>")
        both = self.rows.select("cell", "lot", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("anchor"), *names[1:6],
                                none.alias("low"), none.alias("high")).unionByName(
            routes.select("cell", "lot", F.lit(True).alias("asks"), *names))
        return both.repartition("cell", "lot").sortWithinPartitions("cell", "lot", "asks").mapInArrow(
            scanned, "anchor long, place long, vec_id long, score long")


def _first(found: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted)


def mined(rows: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10,
          percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; other columns are not read. Anchors are the rows whose vec_id is a
    multiple of ``every``; their positives the ``positives`` rows of their label that score highest, without rows of the
    same vec_id. For each, the first ``negatives`` rows of other labels follow whose score is between ``percent`` of the
    positive's. Higher scores come first, ties by smaller vec_id; fewer rows are given if there are no more.
    Null ids, labels and vectors, and null or non-finite components take no part. Shorter vectors count as ending in
    zeros. Repeated rows count once; a vec_id with several vectors or labels takes part with each. Scores must fit 64 bits.
    """
    spark = rows.sparkSession
    vectors = checkpointed(usable(rows).distinct())
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not vectors.take(1):
        return spark.createDataFrame([], schema)
    index = Index(vectors, max(positives + 1, negatives))
    anchors = checkpointed(index.measured(vectors.filter(F.col("vec_id") % every == 0))).withColumn("anchor", F.monotonically_increasing_id())
    anything = F.array(F.struct(F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high")))
    chosen = checkpointed(_first(index.search(anchors, anything, same_label=True, wanted=positives), ["anchor"], positives).select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = F.col("positive_score").cast("decimal(20,0)")
    low, high = (of(share * F.lit(p) / F.lit(100)).cast("long") for of, p in ((F.ceil, percent[0]), (F.floor, percent[1])))
    ranges = chosen.groupBy("anchor").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))),
        lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"))).alias("ranges"))
    found = index.search(anchors.join(ranges, "anchor"), F.col("ranges"), same_label=False, wanted=negatives)
    ranked = _first(found, ["anchor", "place"], negatives)
    return ranked.join(chosen, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
