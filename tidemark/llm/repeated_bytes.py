"""Substring dedup of bytes with suffix order and longest-previous-factor marks.

Pieces of text that may repeat are put in one string; its suffixes are ordered by their first bytes,
as many as a repeat must have at least. In that order the nearest entries to the left and right with
a smaller text position are where the longest earlier match is found. A place has a previous factor
of the full length if it shares the window's rank with one of the two, and a next factor likewise
with the nearest larger positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import passages
from tidemark.llm.hashing import window_keys, window_ranks, window_runs

WINDOW, GRAM = 400, 128


class ByteUnits(passages.Units):
    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)

    def content(self, text: bytes) -> bytes:
        return text

    def runs(self, content: bytes):
        return window_runs(np.frombuffer(content, np.uint8), self.window, self.gram)

    def keys(self, content: bytes):
        return window_keys(np.frombuffer(content, np.uint8), self.window, self.gram)

    def slicer(self, content: bytes) -> Callable[[int, int], bytes]:
        return lambda start, end: content[start:end]

    def size(self, content: bytes) -> int:
        return len(content)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest one before it that is smaller, or -1, by pointer jumps.

    An entry's candidate is its left neighbour; as long as the candidate is not smaller, the
    candidate's own candidate is next, and what lies between cannot be smaller.
    """
    found = np.arange(-1, len(values) - 1)
    open_at = np.flatnonzero((found >= 0) & (values[found] >= values))
    while len(open_at):
        found[open_at] = found[found[open_at]]
        left = found[open_at]
        open_at = open_at[(left >= 0) & (values[left] >= values[open_at])]
    return found


def factor_marks(places: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For text positions and the ranks of their windows: has an earlier match, has a later match."""
    order = np.lexsort((places, ranks))
    position, rank = places[order], ranks[order]

    def matched(values: np.ndarray) -> np.ndarray:
        before = nearest_smaller(values)
        after = len(values) - 1 - nearest_smaller(values[::-1])[::-1]
        hit = (before >= 0) & (rank[before] == rank)
        inside = after < len(values)
        return hit | (inside & (rank[np.where(inside, after, 0)] == rank))

    previous, following = np.empty(len(places), bool), np.empty(len(places), bool)
    previous[order], following[order] = matched(position), matched(-position)
    return previous, following


def compare_bytes(window: int, first_stays: bool) -> passages.Compare:
    def compare(rows):
        # Equal pieces are ordered once: all windows of the later ones repeat those of the first.
        seen: dict[bytes, int] = {}
        first_of = [seen.setdefault(r[5], i) for i, r in enumerate(rows)]
        held = np.array(list(seen.values()))
        copied = np.bincount(first_of, minlength=len(rows)) > 1
        whole = [(i, 0, r[4]) for i, r in enumerate(rows) if first_of[i] != i or copied[i] and not first_stays]
        counts = np.array([rows[i][4] for i in held])
        sizes = np.array([len(rows[i][5]) for i in held])
        ranks = window_ranks(np.frombuffer(b"".join(seen), np.uint8), window)
        piece = np.repeat(np.arange(len(held)), counts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = (np.cumsum(sizes) - sizes)[piece] + offset
        previous, following = factor_marks(places, ranks[places])
        repeated = previous if first_stays else (previous | following) & ~copied[held[piece]]
        at = np.flatnonzero(repeated)
        if not len(at):
            return whole
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(piece[at]) > 0))
        first, last = at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))]
        return whole + list(zip(held[piece[first]].tolist(), offset[first].tolist(), (offset[last] + 1).tolist()))

    return compare


def removed_bytes(docs: DataFrame, *, window: int = WINDOW, first_stays: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_text``).

    Texts are UTF-8 bytes, null ones empty; matches do not cross documents. Removed is each byte
    covered by a ``window`` of bytes that also starts anywhere else, or with ``first_stays`` earlier
    (in a smaller doc_id or earlier in the same document), so that the first copy is kept. n_spans counts
    the maximal removed runs. Repeated rows are copies of each other; rows with null ids come first.
    ``kept_text`` is binary, as cuts may split characters.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(content, begins, ends):
        edges = np.stack((np.concatenate(([0], ends)), np.concatenate((begins, [len(content)]))), axis=1)
        kept = b"".join(content[a:b] for a, b in edges.tolist())
        row = (len(content), len(content) - len(kept), len(begins), hashlib.sha256(kept).hexdigest())
        return (*row, kept) if with_text else row

    return passages.cut_documents(
        docs, ByteUnits(window), compare_bytes(window, first_stays), schema + ", kept_text binary" * with_text, finish,
        first_stays=first_stays)
