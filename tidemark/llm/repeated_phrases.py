"""Repeated phrases by sharded Aho-Corasick automata over words.

Recurring windows of words are confirmed first: passages are the runs of windows that start for the
first time and recur. A shard is a set of whole keys; its passages are compiled into one automaton
over word numbers, keyed by the words that all windows of a passage share. Every text that holds a
recurring key is streamed through the automaton of that key's shard, and each hit is grown to both sides to
the windows it really has in common with the passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import passages
from tidemark.llm.hashing import window_keys, window_ranks, window_runs, word_hashes

WINDOW, GRAM = 20, 6


class WordUnits(passages.Units):
    """Words between ASCII white space; the content is the words with one space between."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)

    def content(self, text: bytes) -> bytes:
        return b" ".join(text.split())

    def runs(self, content: bytes):
        return window_runs(word_hashes(content), self.window, self.gram)

    def keys(self, content: bytes):
        return window_keys(word_hashes(content), self.window, self.gram)

    def slicer(self, content: bytes) -> Callable[[int, int], bytes]:
        words = content.split()
        return lambda start, end: b" ".join(words[start:end])

    def size(self, content: bytes) -> int:
        return content.count(b" ") + 1 if content else 0


def _automaton(cores: dict[tuple[int, ...], list[tuple[int, int]]]):
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for core, holders in cores.items():
        automaton.add_word(core, (len(core), holders))
    automaton.make_automaton()
    return automaton


def recurring_passages(ids: np.ndarray, starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(place, windows) of the passages: runs of windows that recur, each at its first start.

    ``ids`` are the words of all pieces in order, ``starts`` the places of their windows. A run is no
    longer than lets all its windows share some words.
    """
    ranks = window_ranks(ids, window)[starts]
    _, first, inverse, counts = np.unique(ranks, return_index=True, return_inverse=True, return_counts=True)
    places = np.sort(starts[first[counts > 1]])
    out: list[tuple[int, int]] = []
    longest = max(1, (window + 1) // 2)
    for place in places.tolist():
        if out and place == out[-1][0] + out[-1][1] and out[-1][1] < longest:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((place, 1))
    return out


def compare_words(window: int) -> passages.Compare:
    """Finds the windows of each piece that start earlier in another piece or in the piece itself."""
    def compare(rows):
        numbers: dict[bytes, int] = {}
        words = [[numbers.setdefault(w, len(numbers)) for w in r[5].split()] for r in rows]
        begins = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        ids = np.array([n for w in words for n in w], np.int64)
        counts = np.array([r[4] for r in rows])
        starts = np.repeat(begins[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        found = recurring_passages(ids, starts, window)
        if not found:
            return []
        flat = ids.tolist()
        cores: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for place, n in found:
            cores.setdefault(tuple(flat[place + n - 1:place + window]), []).append((place, n))
        automaton = _automaton(cores)
        out: list[tuple[int, int, int]] = []
        for i, own in enumerate(words):
            at, last = int(begins[i]), counts[i]
            again: set[int] = set()
            for end, (size, holders) in automaton.iter(tuple(own)):
                core = end - size + 1
                for place, n in holders:
                    # Windows of the passage around the core: how far to the left and right do words agree?
                    left = 0
                    while left < n - 1 and core - left > 0 and own[core - left - 1] == flat[place + n - 2 - left]:
                        left += 1
                    right, stop = 0, core + size
                    while right < n - 1 and stop + right < len(own) and own[stop + right] == flat[place + window + right]:
                        right += 1
                    # Window j of the passage starts n - 1 - j words before the core and ends j words after it.
                    for j in range(n - 1 - left, right + 1):
                        start = core - (n - 1 - j)
                        if 0 <= start < last and at + start != place + j:
                            again.add(start)
            begin = None
            for s in sorted(again):
                if begin is not None and s == out[-1][2]:
                    out[-1] = (i, begin, s + 1)
                else:
                    begin = s
                    out.append((i, s, s + 1))
        return out

    return compare


def removed_words(docs: DataFrame, *, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. Removed is each word covered by a
    window of ``window`` words of one document that also starts earlier (in a smaller doc_id, or
    earlier in the same document), judged on the input. Kept words are joined by one space. Rows with a
    null doc_id come before others; repeated rows are copies, of which one is the first.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def finish(content, begins, ends):
        words = content.split()
        edges = np.stack((np.concatenate(([0], ends)), np.concatenate((begins, [len(words)]))), axis=1)
        kept = [w for a, b in edges.tolist() for w in words[a:b]]
        text = b" ".join(kept)
        row = (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest())
        return (*row, text.decode()) if with_text else row

    return passages.cut_documents(
        docs, WordUnits(window), compare_words(window), schema + ", kept_text string" * with_text, finish, first_stays=True)
