"""Quality rules with suffix-array repetition inside each document.

The words of a text, numbered, are a string; its suffixes are sorted by doubling the number of words
that are compared, and the stored ranks give the longest common prefixes of neighbours. Intervals of
common prefixes are the repeated substrings; those whose occurrences follow different words cannot be
made longer to the left either and are maximal. The spans of their occurrences are united. A text passes if
the spans cover a limited part of it and the longest maximal repeat is limited too. Several texts share one
array: each numbers its words apart and ends in a number of its own, so repeats never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.repeated_bytes import nearest_smaller

# Words a maximal repeat must have to count, the part of a text that repeats may cover, and their longest.
MIN_REPEAT, MOST_COVERED, MOST_REPEAT = 8, 0.3, 50
LEAST_WORDS, MOST_REPEAT_WORDS = 50, 0.5
WINDOW = 3
# Bytes of text that share one array (one text at least).
CHUNK_BYTES = 1 << 18
SYMBOLS = b"#*$%&|<>"
_SPACE, _INNER = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))


def ranked_levels(units: np.ndarray) -> list[np.ndarray]:
    """Ranks of each place's 1, 2, 4, … units until all places differ.

    ``units`` are numbered from 0 without gaps, and the last one is unique. A rank is the number of places that come
    before all equal ones, so a step only sorts the places that still have equals, within these.
    """
    counts = np.bincount(units)
    ranks = (np.cumsum(counts) - counts)[units]
    levels, width, alike = [ranks.astype(np.int32)], 1, np.flatnonzero(counts[units] > 1)
    while len(alike):
        key = (ranks[alike] << 32) | ranks[alike + width]
        order = np.argsort(key, kind="stable")
        key, alike = key[order], alike[order]
        index = np.arange(len(key))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = np.concatenate(([True], key[1:] >> 32 != key[:-1] >> 32))
        first = np.maximum.accumulate(np.where(new, index, 0))
        ranks = ranks.copy()
        ranks[alike] = (key >> 32) + first - np.maximum.accumulate(np.where(old, index, 0))
        levels.append(ranks.astype(np.int32))
        alike = alike[~(new & np.concatenate((new[1:], [True])))]
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order; 0 for the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < len(order)) & (b < len(order))
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        length += step
        a += step
        b += step
    return np.concatenate(([0], length))


def maximal_repeats(units: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """For each place the length of the longest maximal repeat of at least ``least`` units there, else 0.

    Places whose longest repeat always follows one unit get 0: the place before holds that repeat and more.
    """
    n = len(units)
    out = np.zeros(n, np.int64)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    lcp = common_prefixes(levels, order)
    if not n or int(lcp.max()) < least:
        return out
    # The interval around each neighbouring pair: the suffixes [low, high) that share its common prefix.
    low = np.maximum(nearest_smaller(lcp), 0)
    high = n - 1 - nearest_smaller(lcp[::-1])[::-1]
    before = np.where(order > 0, units[order - 1], -1)
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    maximal = (lcp >= least) & (changes[high - 1] > changes[low])
    # The deepest interval of a suffix is that of its longer common prefix, before or after it.
    after = np.concatenate((lcp[1:], [0]))
    deepest = np.where(lcp >= after, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    out[order] = np.where(maximal[deepest], lcp[deepest], 0)
    return out


def united(places: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Whether each of ``size`` units lies in one of the spans."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_windows(units: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of three units that are found twice, and their lengths."""
    if len(levels) == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = levels[1].astype(np.int64)
    at = np.flatnonzero(np.bincount(pairs)[pairs] > 1)
    _, number, often = np.unique((pairs[at] << 32) | units[at + 2], return_inverse=True, return_counts=True)
    again = at[often[number] > 1]
    return again, np.full(len(again), WINDOW)


@dataclass
class Measures:
    """Of a list of texts: one entry for each text, and the covered spans as word places."""

    n_words: np.ndarray
    word_chars: list[int]
    n_symbols: list[int]
    n_dup_lines: list[int]
    n_repeat_words: np.ndarray
    n_covered: np.ndarray
    longest_repeat: np.ndarray
    spans: list[list[tuple[int, int]]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], least: int) -> Measures:
    """All measures of texts that share one suffix array."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    sizes = counts + 1
    starts = np.cumsum(sizes) - sizes
    units = np.empty(int(sizes.sum()), np.int64)
    numbered = 0
    for w, start in zip(words, starts.tolist()):
        numbers: dict[bytes, int] = {}
        units[start:start + len(w)] = [numbers.setdefault(x, len(numbers)) for x in w]
        units[start:start + len(w)] += numbered
        units[start + len(w)] = numbered = numbered + len(numbers)
        numbered += 1
    levels = ranked_levels(units) if len(texts) else [units]
    in_windows = united(*repeated_windows(units, levels), len(units))
    lengths = maximal_repeats(units, levels, least)
    at = np.flatnonzero(lengths)
    covered = united(at, lengths[at], len(units))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        i = int(np.searchsorted(starts, begin, "right")) - 1
        spans[i].append((begin - int(starts[i]), end - int(starts[i])))

    def per_text(values: np.ndarray, of=np.add) -> np.ndarray:
        return of.reduceat(values.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)

    return Measures(
        counts, [len(t.translate(None, _SPACE + _INNER)) for t in texts],
        [len(t) - len(t.translate(None, SYMBOLS)) for t in texts], [repeated_lines(t) for t in texts],
        per_text(in_windows), per_text(covered), per_text(lengths, np.maximum), spans)


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"


def _measured(texts: pa.Array, least: int) -> tuple[list[list[int]], list]:
    columns, spans = [[] for _ in range(7)], []
    for chunk in _chunks(texts):
        m = measure(chunk, least)
        for column, values in zip(columns, (
                m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.n_covered, m.longest_repeat)):
            column.extend(int(v) for v in values)
        spans.extend(m.spans)
    return columns, spans


def measures(docs: DataFrame, *, least: int = MIN_REPEAT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of the base rules, n_covered, longest_repeat and spans.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``spans`` (begin, end in words) are the united
    occurrences of maximal repeats of at least ``least`` words, n_covered their words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            columns, spans = _measured(batch.column(1), least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns),
                 pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)],
                ["doc_id", *(c.split()[0] for c in _MEASURED.split(", ")), "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id long, {_MEASURED}, spans array<struct<begin:long,end:long>>")


def quality_rules(docs: DataFrame, *, least: int = MIN_REPEAT, most_covered: float = MOST_COVERED,
                  most_repeat: int = MOST_REPEAT) -> DataFrame:
    """The rows of ``measures`` with ``base_failed`` and ``kept``.

    The base rules ask for at least 50 words, of which at most half lie in windows of three words that
    are found twice. A text that passes them is kept if maximal repeats cover at most ``most_covered`` of its words
    and none is longer than ``most_repeat`` words.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(MOST_REPEAT_WORDS))
    passed = (F.col("n_covered") <= F.col("n_words") * F.lit(most_covered)) & (F.col("longest_repeat") <= most_repeat)
    return measures(docs, least=least).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)


def keep_by_rules(docs: DataFrame, **limits) -> DataFrame:
    """``docs``, all its columns, without the rows that the rules reject; rows are judged one by one."""
    least = limits.get("least", MIN_REPEAT)
    most_covered, most_repeat = limits.get("most_covered", MOST_COVERED), limits.get("most_repeat", MOST_REPEAT)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (words, _, _, _, again, covered, longest), _ = _measured(batch.column(at).cast(pa.binary()), least)
            n, again, covered, longest = (np.array(x, np.int64) for x in (words, again, covered, longest))
            good = (n >= LEAST_WORDS) & (again <= n * MOST_REPEAT_WORDS) & (covered <= n * most_covered) & (longest <= most_repeat)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
