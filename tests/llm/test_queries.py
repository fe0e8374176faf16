"""Registered queries of the training-data operators against their SQL, and the pipeline against brute force."""

import os
import re
import sys
from collections import Counter
from itertools import combinations

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tidemark.llm import exact_dedup, mixing, quality, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_check_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cursor.fetchall())


def _firsts_of_near_copies(texts, words=5, similarity=0.8):
    """The smallest id of each component of texts whose sets of word shingles are similar, all pairs compared."""
    sets = {}
    for i, text in texts.items():
        parts = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode().split()
        width = min(words, len(parts))
        sets[i] = {tuple(parts[at:at + width]) for at in range(len(parts) - width + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(i) for i in sets}


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_agree_with_their_operators(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(at))
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        drawn = Counter(r.doc_id for r in after.select("doc_id").collect())
        if at == 0:
            want = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted == 1}
            assert drawn == Counter(want)
        elif at == 1:
            assert drawn == Counter({r.doc_id for r in exact_dedup.exact_groups(docs).collect() if r.kept})
        elif at == 2:
            assert drawn == Counter(_firsts_of_near_copies({i: r.text for i, r in before.items()}))
        elif at == 3:
            assert drawn == Counter(r.doc_id for r in mixing.mixture(docs).collect()) and set(drawn) == set(before)
        else:
            reference = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary())
            for r in after.collect():
                ids = reference.encode(before[r.doc_id].text or "", add_special_tokens=False).ids
                assert r.token_ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        if at < 4:
            assert after.columns == columns and set(drawn) <= ids
        docs = after
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == drawn
