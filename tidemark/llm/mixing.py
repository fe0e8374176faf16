"""Temperature mixing: source weights from exponentiated shares, realised as permuted blocks.

A source's weight is its share of all tokens to a power between 0 (all sources alike) and 1 (as
they come). The power is found by bisection: the largest that reaches a target entropy, but none at
which a source would be repeated more often than allowed. The budget is then dealt out: each source
runs through its documents in blocks, blocks are permuted anew in each round, and the last round
stops where the source's part of the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.skew import packed
from tidemark.session import checkpointed

# Blocks a source is cut into at most; a power of two, as smaller numbers are made by merging.
MOST_BLOCKS = 1 << 16
BLOCK_TOKENS = 1 << 16
# The table of source totals is the one thing that passes through the driver.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """The power, and weight and tokens to draw by source."""

    power: float
    weights: dict[str | None, float]
    quotas: dict[str | None, int]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def powered(totals: list[int], power: float) -> list[float]:
    """Weights of sources with these totals; scaled by the largest first, so that nothing overflows."""
    most = max(totals)
    raised = [(t / most) ** power for t in totals]
    return [r / sum(raised) for r in raised]


def largest_power(holds, steps: int = 60) -> float:
    """The largest power in [0, 1] for which a condition holds that fails above some point; 0 if none."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def solve(totals: dict[str | None, int], *, target_entropy: float = 0.9, most_repeats: float = 2.0,
          budget: int | None = None) -> Mix:
    """Weights and quotas for token totals by source; sources without tokens get neither.

    ``target_entropy`` is a share of the entropy of equal weights. Without a ``budget`` it is the
    least at which every source is drawn in full, so that no document is left out; with one, large
    sources may be cut. No source is drawn more than ``most_repeats`` times, whatever the target.
    """
    sources = sorted((s for s, t in totals.items() if t > 0), key=lambda s: (s is None, s or ""))
    if not sources:
        return Mix(1.0, {}, {})
    counts = [totals[s] for s in sources]

    def drawn(power: float) -> list[float]:
        weights = powered(counts, power)
        size = budget if budget is not None else max(t / w for t, w in zip(counts, weights))
        return [size * w for w in weights]

    def within(power: float) -> bool:
        return all(d <= most_repeats * t * (1 + 1e-12) for d, t in zip(drawn(power), counts))

    goal = target_entropy * math.log(len(sources))
    flat = largest_power(lambda p: entropy(powered(counts, p)) >= goal - 1e-12)
    # Repetition falls as the power rises: the least power that stays within the limit.
    mild = 1.0 - largest_power(lambda q: within(1.0 - q))
    power = max(flat, mild)
    quotas = [min(round(d), math.floor(most_repeats * t)) for d, t in zip(drawn(power), counts)]
    return Mix(power, dict(zip(sources, powered(counts, power))), dict(zip(sources, quotas)))


def _tagged(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` packed, with source, token count (words), hashed order and finest block."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return packed(
        docs, source=F.col("source"), _id=F.col("doc_id"), _text=F.xxhash64(text),
        _tokens=F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        _order=order, _fine=F.pmod(order, F.lit(MOST_BLOCKS)).cast("int"))


def mixed(docs: DataFrame, *, seed: int = 42, block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """``docs``, packed in ``_row``, each row as often as it is drawn, with ``_copy`` (from 0), ``_at``,
    ``_within`` and ``_tokens``.

    Sorting by (``_at``, ``source``, ``_within``) gives the training order: ``_at`` is the part of its
    source's quota drawn before the row's block. Tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text
    has none. A null source is a source of its own; rows of a source without any tokens are drawn
    once. ``limits`` go to ``solve``.
    """
    tagged = _tagged(docs, seed)
    fine = checkpointed(tagged.groupBy("source", "_fine").agg(F.sum("_tokens").alias("tokens")))
    totals = fine.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    mix = solve({r["source"]: r["tokens"] for r in totals}, **limits)
    rows = []
    for r in totals:
        blocks = 1 << max(0, math.ceil(math.log2(max(1.0, r["tokens"] / block_tokens))))
        rows.append((r["source"], r["tokens"], mix.quotas.get(r["source"], 0), min(blocks, MOST_BLOCKS)))
    by_source = docs.sparkSession.createDataFrame(rows, "_src string, _total long, _quota long, _blocks int")
    same = F.col("source").eqNullSafe(F.col("_src"))
    block = F.col("_fine").bitwiseAND(F.col("_blocks") - 1).alias("_block")

    rounds = F.greatest(F.lit(1), F.ceil(F.col("_quota") / F.greatest(F.col("_total"), F.lit(1)))).cast("int")
    drawn = fine.join(F.broadcast(by_source), same).groupBy("_src", "_total", "_quota", block).agg(
        F.sum("tokens").alias("_size")).withColumn("_copy", F.explode(F.sequence(F.lit(0), rounds - 1)))
    shuffled = W.partitionBy("_src", "_copy").orderBy(
        F.xxhash64(F.lit(seed), "_copy", "_src", "_block"), "_block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(shuffled), F.lit(0))
    plan = drawn.withColumn("_start", F.col("_copy") * F.col("_total") + before).select(
        F.col("_src").alias("_plan_src"), F.col("_block").alias("_plan_block"), "_copy",
        (F.col("_start") / F.greatest(F.col("_quota"), F.lit(1))).alias("_at"),
        F.when(F.col("_total") == 0, 0).otherwise(F.col("_quota") - F.col("_start")).alias("_room"),
    ).filter((F.col("_room") > 0) | (F.col("_copy") == 0))

    inside = W.partitionBy("_key", "_block").orderBy("_order", "_id", "_tokens", "_text")
    placed = tagged.join(F.broadcast(by_source), same).select(
        "_row", "_tokens", "_order", "_id", "_text", block, _key("source").alias("_key"),
    ).withColumn("_within", F.sum("_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    rounds = plan.select(_key("_plan_src").alias("_key"), F.col("_plan_block").alias("_block"), "_copy", "_at", "_room")
    return placed.join(rounds, ["_key", "_block"]).filter(F.col("_within") <= F.col("_room")).select(
        "_row", "_copy", "_at", "_within", "_tokens")


def _key(column: str):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The draw without texts: doc_id, source, copy, at, within, n_tokens (see ``mixed``)."""
    return mixed(docs.select("doc_id", "source", "text"), **options).select(
        "_row.doc_id", "_row.source", F.col("_copy").alias("copy"), F.col("_at").alias("at"),
        F.col("_within").alias("within"), F.col("_tokens").alias("n_tokens"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs``, its own columns only, each row as often as it is drawn."""
    return mixed(docs, **options).select("_row.*")
