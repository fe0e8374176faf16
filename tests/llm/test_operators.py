"""The training-data operators against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, chat, exact_dedup, hashing, mixing, passages, pivot_search, quality, queries, repeated_bytes, repeated_phrases,
    shingles, simhash, skew,
)
from tidemark.session import checkpointed

ODD = "doc_id long, text string, source string, _row string, sha string, _id long, _tokens long"
WORDS = "the of and stone river north amber field quiet lamp over under glass wheel seven".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, repeats inside a text, nulls and long texts."""
    rng = random.Random(5)
    passage = _text(rng, 45)
    texts = [_text(rng, rng.randrange(1, 120)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[1] + " x", texts[2] + "\n" + passage, passage + " " + texts[3], passage]
    texts += ["", None, None, "one", "one", " \t\n", "a b", "lamp " * 300, "é" * 900, "x" * 5000, _text(rng, 9000), texts[0]]
    out = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*out, out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", 7, 8) for r in rows], ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def _lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(docs, rows, empty):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(_lowered(text), []).append(doc_id)
    got = exact_dedup.exact_groups(docs, block_bytes=16).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        r, group = by_id[doc_id], groups[_lowered(text)]
        assert (r.keep_id, r.group_size) == (max(group), len(group))
        assert r.text_sha256 == hashlib.sha256(_lowered(text).encode()).hexdigest()
    assert sorted(r.doc_id for r in got if r.kept) == sorted(max(g) for g in groups.values())
    kept = exact_dedup.drop_exact_copies(docs, block_bytes=16)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_groups_without_ids_and_with_shared_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (1, "a"), (2, "x"), (2, "y")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == Counter({(None, 1, 3, False): 2, (1, 1, 3, True): 1, (None, None, 1, True): 1, (2, 2, 1, True): 2})


def test_exact_groups_with_frequent_blocks(spark):
    texts = ["same " * 9] * 300 + [f"text {i % 100} " * (i % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert skew.frequent_keys(df, ["text"]) is not None
    groups = Counter(texts)
    for r in exact_dedup.exact_groups(df, block_bytes=8).collect():
        assert r.group_size == groups[texts[r.doc_id]]


def test_exact_groups_of_frequent_texts_with_an_odd_number_of_blocks(spark):
    texts = [t for n in (17, 33, 50) for t in ["x" * n] * 80] + ["x" * 16, "x" * 17 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, block_bytes=8).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert got == {i: (last[t], texts.count(t), i == last[t]) for i, t in enumerate(texts)}


def test_join_by_key_keeps_all_rows(spark):
    left = spark.createDataFrame([(i % 5 if i < 900 else 5 + i, i) for i in range(1000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    for sizes in (None, "n"):
        assert sorted(r.v for r in skew.join_by_key(left, right, ["k"], F.col("v"), sizes=sizes).collect()) == list(range(1000))


def _print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", _lowered(text).encode())
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_groups(docs, rows, empty):
    prints = {doc_id: _print(text) for doc_id, text, _ in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", find(d)) for d, p in prints.items()}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(d) for d in prints})
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_similar_groups_are_those_of_brute_force(spark, docs, rows, empty):
    rng = random.Random(11)
    texts = {doc_id: text for doc_id, text, _ in rows}
    for base in (_text(rng, 60), _text(rng, 400), _text(rng, 12)):
        for _ in range(30):
            words = base.split()
            for _ in range(rng.randrange(1 + len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts[1000 + len(texts)] = " ".join(words).title()
    page = _text(rng, 22).split()
    texts |= {5000 + i: " ".join(page[:4 + i]) for i in range(19)}
    texts |= {6000: "x y z", 6001: " X\ty Z ", 6002: "x y"}

    def runs(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", _lowered(text).encode())
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))

    sets, root = {d: runs(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    prints = {d: simhash.fingerprint((t or "").encode(), 5) & (1 << 64) - 1 for d, t in texts.items()}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                far += (prints[a] ^ prints[b]).bit_count() > 4
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert far > 20
    more = spark.createDataFrame([(d, texts[d]) for d in texts if d >= 1000], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(more)
    got = shingles.similar_groups(frame)
    assert got.count() == frame.count()
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: find(d) for d in texts}
    kept = simhash.drop_near_copies(frame, words=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(d) for d in texts})
    assert simhash.drop_near_copies(docs, words=5, similarity=0.8).columns == docs.columns
    assert shingles.similar_groups(empty).count() == 0 and simhash.drop_near_copies(empty, similarity=0.8).count() == 0


def test_tables_of_keys_hold_no_sketches(spark, docs, monkeypatch):
    seen = []

    def spy(df):
        seen.append(df.columns)
        return checkpointed(df)

    monkeypatch.setattr(shingles, "checkpointed", spy)
    shingles.similar_groups(docs.select("doc_id", "text"))
    of_keys = [columns for columns in seen if {"key", "node"} <= set(columns) or "low" in columns]
    assert of_keys and not any("sketch" in columns for columns in of_keys)
    ends = spark.createDataFrame(
        [(bytes([n] * 16), 9, 0, bytes([3 - n] * 16), 8, 0) for n in (1, 2, 1)],
        "node binary, size int, place int, node_b binary, size_b int, place_b int")
    assert [(r.a[0], r.b[0], r.total) for r in shingles._pairs(ends, 0.8).collect()] == [(1, 2, 17)]


def test_links_in_dense_groups_and_chains(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    prints = {base}
    while len(prints) < 300:
        prints.add(base ^ sum(1 << rng.randrange(60) for _ in range(2)))
    chain = rng.getrandbits(62)
    for i in range(12):
        prints.add(chain)
        chain ^= 0b1111 << (i * 5)
    points = spark.createDataFrame([(p,) for p in prints], "print long")
    got = {r.node: r.root for r in simhash.components(simhash.links(points)).collect()}
    left = set(prints)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        assert {got.get(x, x) for x in part} == {min(part)}


def test_removed_words(docs, rows, empty):
    def brute(window):
        seen, out = set(), Counter()
        for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
            words = (text or "").encode().split()
            gone = [False] * len(words)
            for i in range(len(words) - window + 1):
                phrase = tuple(words[i:i + window])
                if phrase in seen:
                    gone[i:i + window] = [True] * window
                seen.add(phrase)
            kept = b" ".join(w for w, g in zip(words, gone) if not g)
            out[doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
        return out

    for window in (20, 7):
        got = repeated_phrases.removed_words(docs, window=window, with_text=True).collect()
        assert Counter(tuple(r)[:4] for r in got) == brute(window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert repeated_phrases.removed_words(empty).count() == 0


def _brute_bytes(rows, window, first_stays):
    texts = [(d, (t or "").encode()) for d, t, _ in sorted(rows, key=lambda r: r[0])]
    counts = Counter(b[i:i + window] for _, b in texts for i in range(len(b) - window + 1))
    seen, out = set(), Counter()
    for doc_id, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if (b[i:i + window] in seen) if first_stays else counts[b[i:i + window]] > 1:
                gone[i:i + window] = True
            seen.add(b[i:i + window])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("first_stays", [False, True])
def test_removed_bytes(docs, rows, empty, first_stays):
    got = repeated_bytes.removed_bytes(docs, window=100, first_stays=first_stays).collect()
    assert Counter(map(tuple, got)) == _brute_bytes(rows, 100, first_stays)
    assert repeated_bytes.removed_bytes(empty).count() == 0


def test_frequent_keys_give_the_same_cuts(docs, rows, monkeypatch):
    monkeypatch.setattr(passages, "KEY_PIECES", 2)
    got = repeated_bytes.removed_bytes(docs, window=100).collect()
    assert Counter(map(tuple, got)) == _brute_bytes(rows, 100, False)


def test_nearest_smaller_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50):
        v = rng.permutation(n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert repeated_bytes.nearest_smaller(v).tolist() == want
    units = rng.integers(0, 2, 60)
    for window in (1, 5, 8, 13):
        runs = [tuple(units[i:i + window]) for i in range(60 - window + 1)]
        order = {r: i for i, r in enumerate(sorted(set(runs)))}
        assert hashing.window_ranks(units, window).tolist() == [order[r] for r in runs]
        assert hashing.window_ranks(units.astype(np.uint8), window).tolist() == [order[r] for r in runs]
        assert len(hashing.gram_hashes(units, window)) == len(runs)
        assert len({(r, h) for r, h in zip(runs, hashing.gram_hashes(units, window).tolist())}) == len(set(runs))


def _vectors(spark, n=260, width=6):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(0, 0.3, width)]) for i in range(n)]
    v += [(n + i, [0.5] * width) for i in range(90)]
    bad = [(1000, None), (1050, [0.1, None] + [0.0] * 4), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (None, [0.1] * 6)]
    return v, spark.createDataFrame(v + bad + [v[3]], "vec_id long, embedding array<float>")


def test_top_inner_products(spark):
    v, df = _vectors(spark)
    ids = np.array([i for i, _ in v])
    m = np.floor(256 * np.array([x for _, x in v], np.float32).astype(float)).astype(np.int64)
    want = set()
    for i in ids[ids % 50 == 0]:
        scores = m @ m[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        want |= {(int(i), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    got = [tuple(r) for r in pivot_search.top_inner_products(df).collect()]
    assert len(got) == len(want) and set(got) == want
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0, 1.0]), (7, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in pivot_search.top_inner_products(few).collect()) == [
        (0, 1, 50, 131072), (0, 2, 7, 0), (50, 1, 0, 131072), (50, 2, 7, 0)]
    assert pivot_search.top_inner_products(df.limit(0)).count() == 0


def _tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_the_library(docs, rows, empty):
    reference = _tokenizer()
    path = queries.vocabulary()
    encoded = bpe.encode_documents(docs, path)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode_documents(encoded, path).collect()}
    digests = bpe.encoded_digests(docs, path).collect()
    assert len(digests) == len(rows)
    for doc_id, text, _ in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id] == ids and decoded[doc_id] == reference.decode(ids, skip_special_tokens=False)
    for r in digests:
        ids = got[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()
    assert bpe.encoded_digests(empty, path).count() == 0


def test_bpe_on_random_strings():
    reference, mine = _tokenizer(), bpe.Encoder(queries.vocabulary())
    rng = random.Random(4)
    parts = ["İ", "Σ", "ß", "é", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "'ll", "'S", "…", "!!", "　", "\n", "😀", "中文", "ǅ"]
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.4:
            s = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(12)))
        elif kind < 0.7:
            s = "".join(rng.choice("aeiourstnl'12 ") for _ in range(rng.randrange(40)))
        else:
            s = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = reference.encode(s, add_special_tokens=False).ids
        assert mine.encode(s).tolist() == ids and mine.decode(np.array(ids, np.int64)) == reference.decode(ids, skip_special_tokens=False)


def test_chat_layouts_and_round_trip(spark):
    hard = "a\\b <s>\\<|end|> <|end<|end|>|> \\\\[INST]\n<|turn|>é"
    turns = [(1, 0, "system", hard), (1, 1, "assistant", hard), (1, 1, "us<s>er", None), (1, 2, None, ""), (None, 0, "assistant", "z"), (2, None, "assistant", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.formatted_turns(chat.canonical_turns(chat.turn_records(table)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    order = [(1, hard, "system"), (2, hard, "assistant"), (3, "", "us<s>er"), (4, "", "")]
    said = "".join(f"{role}\n{text}\n" for _, text, role in sorted(order))
    assert got[1].n_turns == 4 and got[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and got[1].loss_chars == len(hard)
    assert got[1].turns_sha256 in {hashlib.sha256(s.encode()).hexdigest() for s in (
        said, "".join(f"{r}\n{t}\n" for _, t, r in (order[0], order[2], order[1], order[3])))}
    assert got[None].loss_chars == 1 and got[2].loss_chars == 0
    for r in formatted.collect():
        body = r.chunk.removeprefix(chat.OPEN)[: -len(chat.CLOSE) - 1]
        assert not any(c in body.replace(chat.BODY, "", 1) for c in chat.CONTROL)
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, [("user", "q"), ("assistant", "r")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"system": "", "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"other": {"deep": [1]}}, [(None, None)]),
    ]
    raw = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, None), (91, "{broken"), (92, "[1]")]
    rows = chat.canonical_turns(spark.createDataFrame(raw, "conv_id long, record string")).collect()
    for i, (_, want) in enumerate(records):
        assert [(r.role, r.text) for r in sorted((r for r in rows if r.conv_id == i), key=lambda r: r.turn or 0)] == want
    assert {r.conv_id for r in rows if r.layout is None} == {4, 90, 91, 92}
    assert chat.read_back(formatted.limit(0)).count() == 0


def test_mixing_solves_and_draws(spark, docs, rows, empty):
    totals = {"a": 900, "b": 90, "c": 10, "none": 0}
    for target, repeats in ((0.5, 9.0), (0.99, 2.0), (1.0, 1e9)):
        mix = mixing.solve(totals, target_entropy=target, most_repeats=repeats)
        assert abs(sum(mix.weights.values()) - 1) < 1e-9 and "none" not in mix.quotas
        assert all(totals[s] <= q <= repeats * totals[s] for s, q in mix.quotas.items())
        reached = mixing.entropy(list(mix.weights.values())) / np.log(3)
        assert reached >= target - 1e-6 or max(mix.quotas[s] / totals[s] for s in mix.quotas) > repeats - 0.11
    assert mixing.solve({}).quotas == {} and mixing.solve({"a": 5}).quotas == {"a": 5}
    drawn = mixing.mixture(docs, block_tokens=50, target_entropy=0.999, most_repeats=3.0).collect()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").encode().split())
    mix = mixing.solve(dict(tokens), target_entropy=0.999, most_repeats=3.0)
    most = max(len((t or "").split()) for _, t, _ in rows)
    assert {r.doc_id for r in drawn} == {r[0] for r in rows}
    for source, quota in mix.quotas.items():
        got = sum(r.n_tokens for r in drawn if r.source == source)
        assert quota - most < got <= quota
    assert Counter(r.doc_id for r in drawn)[4] >= 3  # three equal rows stay three
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and mixing.mixture(empty).count() == 0


def test_mixing_cuts_with_a_budget(spark):
    df = spark.createDataFrame([(i, "w " * 10, "big" if i % 10 else "small") for i in range(500)], "doc_id long, text string, source string")
    drawn = mixing.mixture(df, block_tokens=100, budget=1000, target_entropy=1.0, most_repeats=1.0).collect()
    got = Counter()
    for r in drawn:
        got[r.source] += r.n_tokens
    assert got["small"] == 500 and got["big"] == 500 and len({r.doc_id for r in drawn}) == len(drawn)


def test_quality_held_out_accuracy(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) >= 0.9
    assert all(r.predicted == 1 for r, q in held if q == 1)


def test_quality_with_little_to_learn(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == 1 for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(empty, labels).count() == 0
    assert len(quality.indicators(None)) == 0 and len(quality.indicators(b" ")) == 0
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, 20) + 60 * (i % 2)) for i in range(200)]
    model = quality.fit(sets, np.arange(200) % 2)
    assert all((model.score(s) > 0.5) == bool(i % 2) for i, s in enumerate(sets))


def test_the_fit_holds_its_rows_once():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, quality.SLOTS, 4000)).astype(np.int32) for _ in range(1500)]
    sets[7:9], labels = [sets[3], sets[3][:40]], rng.integers(0, 2, len(sets)).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(labels, pa.int32())], ["slots", "label"])
    tracemalloc.start()
    next(quality._fit_batches(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 2
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), labels[i]))
    assert [(sets[i].tobytes(), labels[i]) for i in quality._ordered(sets, labels)] == [(sets[i].tobytes(), labels[i]) for i in order]


def test_phrase_keys_are_hashed_once_a_text(spark):
    from tidemark.llm import passages, repeated_phrases as R

    hashed = spark.sparkContext.accumulator(0)

    class Counted(R.WordUnits):
        def keys(self, content):
            hashed.add(1)
            return super().keys(content)

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 40])) for i in range(12)], "doc_id long, text string")
    rows = passages.cut_documents(docs, Counted(), R.compare_words(20), "doc_id long, n_words long, n_removed long",
                                  lambda c, a, b: (len(c.split()), int((b - a).sum())), first_stays=True).collect()
    assert hashed.value == 12
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, **{i: 39 for i in range(1, 12)}}
