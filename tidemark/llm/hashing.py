"""Vectorised hashes of n-grams and words, and sliding minima; used as keys only, never as identity."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x100000001B3)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def is_space(b: np.ndarray) -> np.ndarray:
    """White space of ASCII: 0x20 and 0x09 to 0x0D."""
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    space = is_space(b)
    edges = np.diff(np.concatenate(([False], ~space, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    begins = np.zeros(len(b), np.int64)
    begins[starts] = starts
    at = np.arange(len(b)) - np.maximum.accumulate(begins)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), STEP))))
    value = np.where(space, np.uint64(0), (b + np.uint64(1)) * powers[np.minimum(at, len(powers) - 1)])
    return np.add.reduceat(value, starts) + lengths.astype(np.uint64)


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of ``size`` units, put together from runs of powers of two."""
    width, run, power, rest = 1, units.astype(np.uint64), _BASE, size
    done, out = 0, None
    while rest:
        if rest & 1:
            if out is None:
                out = run
            else:
                n = min(len(out), len(run) - done)
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = out[:n] * np.uint64(power) + run[done:done + n]
            done += width
        rest >>= 1
        if rest:
            n = len(run) - width
            if n <= 0:
                return np.empty(0, np.uint64)
            run = run[:n] * np.uint64(power) + run[width:]
            power, width = power * power & _MASK, 2 * width
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    n, low = 1, values
    while 2 * n <= width:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    count = len(values) - width + 1
    return np.minimum(low[:count], low[width - n:width - n + count])


def window_runs(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of each run of windows that share their smallest gram hash.

    Equal windows, wherever they are, have equal keys.
    """
    low = sliding_min(gram_hashes(units, gram), window - gram + 1)
    if not len(low):
        none = np.empty(0, np.int64)
        return none, none, none
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[starts].view(np.int64), starts, np.diff(np.concatenate((starts, [len(low)])))


def window_keys(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, pieces, grams): how many pieces of ``window_runs`` have a key, and how many grams hash to it.

    Windows with one key can only be equal if their gram is there twice, in one piece or in several.
    """
    grams = gram_hashes(units, gram)
    low = sliding_min(grams, window - gram + 1)
    if not len(low):
        none = np.empty(0, np.int64)
        return none, none, none
    keys, pieces = np.unique(low[np.concatenate(([True], low[1:] != low[:-1]))], return_counts=True)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return keys.view(np.int64), pieces, np.bincount(at[keys[at] == grams], minlength=len(keys))


def window_ranks(units: np.ndarray, window: int) -> np.ndarray:
    """The order of each place's run of ``window`` units among all, equal runs alike.

    Ranks of runs of one, two, four … units are paired until they reach the window; the last pair
    overlaps. Bytes begin with runs of eight, read as one number. ``units`` are smaller than 2 ** 31;
    places too near the end for a whole run get none.
    """
    width = 8 if units.dtype == np.uint8 and window >= 8 else 1
    if width == 8:
        if len(units) < 8:
            return np.empty(0, np.int64)
        wide = units.astype(np.uint64)
        for step in (1, 2, 4):
            wide = (wide[:-step] << np.uint64(8 * step)) | wide[step:]
        units = wide
    ranks = np.unique(units, return_inverse=True)[1].astype(np.int64)
    while width < window:
        step = min(width, window - width)
        if len(ranks) <= step:
            return ranks[:0]
        ranks = np.unique((ranks[:-step] << 32) | ranks[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    return ranks
