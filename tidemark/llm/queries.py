"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    bpe, chat, exact_dedup, hard_negatives, merkle, mixing, pivot_search, quality, repeated_bytes, repeated_phrases,
    repetition, simhash, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages")))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query
def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.removed_words(table(spark, sf_dir, "documents"))


ORACLE["op4_phrase_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS phrase
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)
), again AS (
  SELECT doc_id, i AS first FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS place FROM w)
  WHERE place > 1
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS removed FROM (SELECT doc_id, unnest(range(first, first + 20)) AS i FROM again) GROUP BY doc_id
), cut AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(removed), 0) AS n_removed, words, removed
  FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d
  ) x ANTI JOIN (SELECT doc_id, unnest(removed) AS i FROM gone) y USING (doc_id, i)
  GROUP BY doc_id
)
SELECT cut.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN left_over ON left_over.doc_id = cut.doc_id
"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.removed_bytes(table(spark, sf_dir, "documents"))


@query
def op7_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE["op7_pivot_search"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one record per turn, and one more as a record of messages."""
    control = [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]
    extra = spark.createDataFrame([(-1, json.dumps({"messages": control}))], "conv_id long, record string")
    records = chat.turn_records(table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat.read_back(chat.formatted_turns(chat.canonical_turns(records)))


_MARKS = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in (*chat.CONTROL, "\\"))
ORACLE["op9_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.OPEN + chat.BODY + chat.CLOSE) + 1} + length(role) + length(text)
                + {_MARKS.format("role")} + {_MARKS.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")


def _again(width: int) -> str:
    """Words of each text in windows of ``width`` words that are found twice or more in it."""
    return f"""(
  SELECT id, count(DISTINCT p) AS n FROM (
    SELECT id, unnest(range(i, i + {width})) AS p FROM (
      SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(list_slice(words, i, i + {width - 1}), ' ')) AS found
      FROM (SELECT id, words, unnest(range(1, len(words) - {width - 2})) AS i FROM d WHERE len(words) >= {width}))
    WHERE found > 1) GROUP BY id)"""


# A maximal repeat longer than the limit is there if a window one word longer is found twice.
ORACLE["op11_repetition"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words
  FROM documents
), lines AS (
  SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY id
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(windows.n, 0) AS n_repeat_words, coalesce(covered.n, 0) AS n_covered, long.id IS NOT NULL AS too_long
  FROM d LEFT JOIN lines ON lines.id = d.id LEFT JOIN {_again(repetition.WINDOW)} windows ON windows.id = d.id
  LEFT JOIN {_again(repetition.MIN_REPEAT)} covered ON covered.id = d.id
  LEFT JOIN {_again(repetition.MOST_REPEAT + 1)} long ON long.id = d.id
), b AS (
  SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed,
       NOT base_failed AND NOT too_long AND n_covered <= n_words * CAST({repetition.MOST_COVERED} AS DOUBLE) AS kept
FROM b
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in ``embeddings``, with the labels of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", moved))


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored JOIN positives USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, checked against rows whose line ends are lost where crc32 of the id is even."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(table(spark, sf_dir, "documents"), text)


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.FIELDS[:-1]) + " || " + _FIELD + ")"
ORACLE["op13_merkle"] = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step
), leaf AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos,
         count(*) OVER (PARTITION BY key) AS n
  FROM (
    SELECT coalesce('=' || source, '') AS key, doc_id, {_LEAF.format("text")} AS leaf,
           CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                  lambda c, b: xor(c // 256, step[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 2 = 0
             THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS seen
    FROM documents, crc)
), inner_tree AS (
  SELECT key, 0 AS lvl, pos, leaf AS h, n FROM leaf
  UNION ALL
  SELECT key, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM inner_tree WHERE n > 1 GROUP BY key, lvl, pos // 3
), subroots AS (
  SELECT key, lvl AS depth, h, CAST(row_number() OVER (ORDER BY encode(key)) - 1 AS BIGINT) AS pos, count(*) OVER () AS n
  FROM inner_tree WHERE n = 1
), outer_tree AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM outer_tree WHERE n > 1 GROUP BY lvl, pos // 3
), steps AS (
  SELECT row_number() OVER () AS id, l.doc_id, l.leaf, l.seen, l.key, l.pos, s.depth, s.h AS subroot, s.pos AS s_pos FROM leaf l JOIN subroots s USING (key)
), runs AS (
  SELECT id, t.lvl, t.pos % 3 AS place, t.pos = x.pos // CAST(pow(3, t.lvl) AS BIGINT) AS own, t.h
  FROM steps x JOIN inner_tree t ON t.key = x.key AND t.n > 1
   AND t.pos // 3 = x.pos // CAST(pow(3, t.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT id, x.depth + t.lvl, t.pos % 3, t.pos = x.s_pos // CAST(pow(3, t.lvl) AS BIGINT), t.h
  FROM steps x JOIN outer_tree t ON t.n > 1 AND t.pos // 3 = x.s_pos // CAST(pow(3, t.lvl + 1) AS BIGINT)
), sides AS (
  SELECT id, lvl, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < mine), '') AS lefts,
         coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > mine), '') AS rights
  FROM (SELECT *, max(place) FILTER (WHERE own) OVER (PARTITION BY id, lvl) AS mine FROM runs) GROUP BY id, lvl
), folds AS (
  SELECT id, 0 AS lvl, seen AS h FROM steps
  UNION ALL
  SELECT f.id, f.lvl + 1, sha256(s.lefts || f.h || s.rights) FROM folds f JOIN sides s ON s.id = f.id AND s.lvl = f.lvl
), ends AS (
  SELECT id, arg_max(h, lvl) AS folded_root FROM folds GROUP BY id
), proofs AS (
  SELECT id, sha256(string_agg(lefts || rights, '' ORDER BY lvl)) AS proof_sha256 FROM sides GROUP BY id
)
SELECT doc_id, leaf, subroot, (SELECT h FROM outer_tree WHERE n = 1) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM outer_tree WHERE n = 1) AS verified
FROM steps JOIN ends USING (id) LEFT JOIN proofs USING (id)
"""
