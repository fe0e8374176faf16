"""Hard negatives against all pairs, and the bounds against true scores."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, cell int, v string"


def brute_force(rows, every, positives, negatives):
    kept = set()
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for a, label, v in sorted(kept):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), c, m) for c, m, w in kept if c != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            near = sorted((t, c) for t, c, m in scored if m != label and -30 * s <= -100 * t <= -90 * s)
            out += [(a, p, n + 1, c, -s, -t) for n, (t, c) in enumerate(near[:negatives])]
    return Counter(out)


def _check(spark, rows, every=10, positives=3, negatives=4):
    df = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], SCHEMA).repartition(3)
    got = hn.mined(df, every=every, positives=positives, negatives=negatives)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_force(rows, every, positives, negatives)
    assert Counter(tuple(r) for r in got.collect()) == want and want


def _clusters(rng, n, width, centres, spread):
    middle = rng.normal(size=(centres, width))
    v = middle[rng.integers(centres, size=n)] + rng.normal(size=(n, width)) * spread
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).tolist()


def test_mined_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ROWS", 30)
    monkeypatch.setattr(hn, "LOT_COMPONENTS", 100)
    monkeypatch.setattr(hn, "WINDOW_ROWS", 8)
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(_clusters(rng, 260, 6, 4, 0.3))]
    rows += [(300 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(60)]  # one vector many times, in two labels
    rows += [(400, [0.0] * 6, 0), (410, [], 1), (411, [0.1, 0.2], 1), (420, [3.0, -2.0, 5.0, 1.0, 0.0, 9.0], 2), (430, [-x for x in rows[0][1]], 2)]
    rows += [(None, rows[1][1], 1), (440, None, 1), (450, rows[2][1], None), (460, [float("nan")] + [0.1] * 5, 0), (470, [None] + [0.1] * 5, 0),
             (480, [float("inf")] * 6, 1), (500, rows[3][1], 9), (-10, rows[4][1], 1), (20, rows[5][1], 2), rows[10], rows[10]]
    _check(spark, rows)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e5, 1e7])
def test_mined_on_long_vectors(spark, scale):
    rng = np.random.default_rng(2)
    _check(spark, [(i, [x * scale for x in v], i % 2) for i, v in enumerate(_clusters(rng, 120, 9, 3, 0.5))], positives=2)


def test_nothing_to_mine(spark):
    for rows in ([], [(100, None, 1, 1, 1, "")], [(100, [1.0], 1, 1, 1, "")], [(1, [1.0], 1, 1, 1, ""), (2, [1.0], 1, 1, 1, "")]):
        assert hn.mined(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_bounds_hold_and_prune_clusters():
    rng = np.random.default_rng(3)
    v = np.floor(256 * np.array(_clusters(rng, 4000, 32, 40, 0.05))).astype(np.int64)
    v[:3] = 0
    length, angles = hn.lengths_and_angles(v, hn.spread_directions(v[3:] / np.linalg.norm(v[3:], axis=1)[:, None], 16))
    lot = hn.Lot(np.arange(len(v)), np.zeros(len(v), np.int64), v, length, angles.astype(np.float32), 0)
    low, high = hn.score_bounds(length[:200], angles[:200], lot.windows)
    score = v[:200] @ lot.v.T
    for w, (a, b) in enumerate(zip(lot.starts, lot.ends)):
        assert (score[:, a:b] >= low[:, w, None]).all() and (score[:, a:b] <= high[:, w, None]).all()
    fifth = np.sort(score, axis=1)[:, -5]
    # On tight clusters few windows can hold one of the best five; a window holds 1/32 of the rows.
    assert (high[3:] >= fifth[3:, None]).mean() < 0.6


def test_first_rows_in_ranges():
    owner, ids, score = np.array([0, 0, 0, 1, 1, 0]), np.array([5, 3, 4, 1, 2, 9]), np.array([7, 7, 8, 1, 1, 2])
    place, row = hn.best_in_ranges(owner, ids, score, np.array([[0, 8], [1, 5]]), np.array([[7, 9], [1, 6]]), 2)
    assert sorted((int(owner[r]), int(p), int(ids[r])) for p, r in zip(place, row)) == [(0, 0, 3), (0, 0, 5), (0, 1, 4), (1, 0, 1), (1, 0, 2)]
