"""Text quality by Naive Bayes support vectors.

A text is the set of its n-grams: of bytes, of words, and of marks that say whether a word repeats
the one before it. Each indicator is scaled by the log-ratio of its counts in the two classes; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent, and its
margins are turned into probabilities by a logistic curve fitted on rows the model did not see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.carry import carried
from tidemark.llm.hashing import STEP, word_hashes

# Labelled rows the model is fitted on at most, the ones with the smallest hash of their id.
SAMPLE_ROWS = 20_000
SLOTS = 1 << 17
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, slots: np.ndarray) -> float:
        x = self.ratios[slots]
        margin = float(x @ self.weights[slots]) / max(float(np.sqrt(x @ x)), 1e-12) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30.0, 30.0))))


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    mixed = (values + np.uint64(kind)) * _MIX
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted slots of the n-grams a text holds; an empty or null text holds none."""
    text = text or b""
    seen = np.zeros(SLOTS, bool)
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    gram = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        gram = (gram[:-1] << np.uint64(8)) | b[n - 1:]
        seen[_slots(gram, n)] = True
    word = word_hashes(text)
    if len(word):
        seen[_slots(word, 5)] = True
        if len(word) > 1:
            seen[_slots(word[:-1] * STEP + word[1:], 6)] = True
            again = (word[1:] == word[:-1]).astype(np.uint64)
            for n in (1, 2, 3):
                if len(again) >= n:
                    marks = sum(again[i:len(again) - n + 1 + i] << np.uint64(i) for i in range(n))
                    seen[_slots(marks, 6 + n)] = True
    return np.flatnonzero(seen)


def fit(rows: list[np.ndarray], labels: np.ndarray, *, smoothing: float = 1.0, cost: float = 1.0,
        passes: int = 10, seed: int = 42) -> Model:
    """The model of sets of slots with labels 0 and 1; every fifth row only fits the logistic curve.

    With one class or no rows the score is the share of label 1 (a half without rows). A row is scaled each time
    it is used, so the rows themselves are all that is held of them.
    """
    zeros = np.zeros(SLOTS, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(rows) < 10 or share in (0.0, 1.0):
        clipped = min(max(share, 0.01), 0.99)
        return Model(zeros, zeros, 0.0, 0.0, float(np.log(clipped / (1 - clipped))))
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(rows)) % 5 == 0
    used = np.flatnonzero(~apart)
    counts = np.full((2, SLOTS), smoothing)
    for i in used:
        counts[int(labels[i]), rows[i]] += 1
    ratios = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    y = np.where(labels == 1, 1.0, -1.0)
    norms = {i: max(float(np.linalg.norm(ratios[rows[i]])), 1e-12) for i in used}
    weights, bias = np.zeros(SLOTS, np.float32), 0.0
    dual = np.zeros(len(rows))
    for _ in range(passes):
        for i in rng.permutation(used):
            x = ratios[rows[i]] / norms[i]
            slope = y[i] * (float(weights[rows[i]] @ x) + bias) - 1.0
            new = min(max(dual[i] - slope / 2.0, 0.0), cost)  # a unit vector and the constant: norm 2
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                weights[rows[i]] += np.float32(step) * x
                bias += step
    plain = Model(ratios, weights, bias, 1.0, 0.0)
    checked = np.flatnonzero(apart)
    margins = np.array([np.log(p / (1 - p)) for p in (plain.score(rows[i]) for i in checked)])
    return Model(ratios, weights, bias, *_logistic(margins, labels[checked]))


def _logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve by damped Newton steps on softened labels."""
    ones, zeros = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (ones + 1.0) / (ones + 2.0), 1.0 / (zeros + 2.0))
    x = np.stack((margins, np.ones_like(margins)), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
        at = np.clip(at, [0.1, -20.0], [20.0, 20.0])
    return float(at[0]), float(at[1])


def _indicator_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [indicators(x.as_py()).astype(np.int32).tobytes() for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), batch.column(1)], ["slots", "label"])


def _ordered(rows: list[np.ndarray], labels: list[int]) -> list[int]:
    """The rows' places ordered by their bytes and labels; only rows that begin alike are copied to be compared."""
    def head(i: int) -> bytes:
        return rows[i][:16].tobytes()

    alike = groupby(sorted(range(len(rows)), key=head), head)
    return [i for _, some in alike for i in sorted(some, key=lambda i: (rows[i].tobytes(), labels[i]))]


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Rows are read where the batches hold them; nothing is copied.
    rows, labels = [], []
    for batch in batches:
        rows.extend(np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0))
        labels.extend(batch.column(1).to_pylist())
    order = _ordered(rows, labels)
    m = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.int64))
    yield pa.RecordBatch.from_pylist([{
        "ratios": m.ratios.tobytes(), "weights": m.weights.tobytes(), "bias": m.bias,
        "slope": m.slope, "offset": m.offset}])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's digits is a multiple of five; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    Only the sample (its size is the bound of the broadcast) and its sets of slots leave the scan;
    the fit is one task over the sample, and the model has a fixed size.
    """
    sample = (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "_label")
    got = rows.mapInArrow(_indicator_batches, "slots binary, label int").repartition(1).mapInArrow(
        _fit_batches, "ratios binary, weights binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(got["ratios"], np.float32), np.frombuffer(got["weights"], np.float32),
                 got["bias"], got["slope"], got["offset"])


def _scorer(docs: DataFrame, model: Model) -> Callable[[pa.Array], np.ndarray]:
    shared = carried(docs.sparkSession, (model.ratios, model.weights, model.bias, model.slope, model.offset), lambda plain: Model(*plain))
    return lambda texts: np.array([shared().score(indicators(x.as_py())) for x in texts], np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality (0 or 1; other values are not used). A score uses the whole
    text and nothing else; empty and null texts get the score of an empty set. Without labels of
    both classes all scores are the share of label 1.
    """
    score = _scorer(docs, train(docs, labels, sample_rows=sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all its columns, without the rows that score below ``threshold``."""
    score = _scorer(docs, train(docs, labels, sample_rows=sample_rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array(score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
