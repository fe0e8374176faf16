"""Suffix-array repetition against plain counts of windows and plain lists of maximal repeats."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repetition

SCHEMA = "doc_id long, text string, n_words long, spans string, kept boolean"
WORD = re.compile("[^\x20\x09-\x0D]+")


def _windows(words, width):
    """Places of words in windows that are found twice."""
    found = Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return {p for i in range(len(words) - width + 1) if found[tuple(words[i:i + width])] > 1 for p in range(i, i + width)}


def _maximal(words, least):
    """Maximal repeats of at least ``least`` words, tried one by one."""
    out = set()
    n = len(words)
    for length in range(least, n):
        at = {}
        for i in range(n - length + 1):
            at.setdefault(tuple(words[i:i + length]), []).append(i)
        for seq, places in at.items():
            lefts = {words[p - 1] if p else None for p in places}
            rights = {words[p + length] if p + length < n else None for p in places}
            if len(places) > 1 and (len(lefts) > 1 or None in lefts) and (len(rights) > 1 or None in rights):
                out.add((seq, tuple(places)))
    return out


def _texts():
    rng = random.Random(3)
    words = "a b c d e".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 70))) for _ in range(60)]
    line = " ".join(f"w{i}" for i in range(30))
    texts += ["same " * 120, "a b " * 80, f"{line}\nother\n{line}\n\n \n{line}", " ".join(f"u{i}" for i in range(80)),
              line + " x " + line + " y " + " ".join(f"v{i}" for i in range(90)), "# a*b $%\n# a*b $%\n&|<>", "", None, " \t\n\x0b", "é ü　z  é"]
    long = " ".join(f"p{i % 977}q{i % 89}" for i in range(40_000))
    return texts + [long, texts[0], texts[0]]


@pytest.mark.parametrize("least", [1, 2, 8])
def test_maximal_repeats(least):
    for text in _texts()[:-4]:
        words = WORD.findall(text or "")
        if len(words) > 130:
            continue
        m = repetition.measure([(text or "").encode()], least)
        repeats = _maximal(words, least)
        covered = {p for seq, places in repeats for at in places for p in range(at, at + len(seq))}
        assert {p for a, b in m.spans[0] for p in range(a, b)} == covered == _windows(words, least)
        assert m.longest_repeat[0] == max((len(seq) for seq, _ in repeats), default=0)
        assert all(b < a for (_, b), (a, _) in zip(m.spans[0], m.spans[0][1:]))


def test_quality_rules(spark, monkeypatch):
    monkeypatch.setattr(repetition, "CHUNK_BYTES", 600)
    texts = _texts()
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in enumerate(texts)] + [(None, None, 1, "x", None)] * 2, SCHEMA)
    got = repetition.quality_rules(df.repartition(3), least=8, most_repeat=25).collect()
    assert len(got) == len(texts) + 2 and sum(r.doc_id is None for r in got) == 2
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else None
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        again, covered = _windows(words, 3), _windows(words, 8)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""))
        assert (r.n_dup_lines, r.n_repeat_words, r.n_covered) == (len(lines) - len(set(lines)), len(again), len(covered))
        assert r.base_failed == failed
        assert r.kept == (not failed and len(covered) <= 0.3 * len(words) and not _windows(words, 26))
    assert {r.kept for r in got} == {True, False}
    kept = repetition.keep_by_rules(df, least=8, most_repeat=25)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_empty_table_and_one_word_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repetition.quality_rules(empty).count() == 0 and repetition.keep_by_rules(empty).count() == 0
    one = repetition.measure([b"word " * 50_000], 8)
    assert (one.longest_repeat[0], one.n_covered[0], one.spans[0]) == (49_999, 50_000, [(0, 50_000)])
    assert repetition.measure([], 8).n_words.tolist() == [] and np.array_equal(repetition.measure([b""], 8).n_words, [0])
