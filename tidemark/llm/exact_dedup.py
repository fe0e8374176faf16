"""Exact dedup by block naming: equal texts get equal integers without comparing hashes.

Texts are cut into blocks of a fixed number of bytes. Blocks are sorted, and the place of the
first of equal blocks is their name. Neighbouring names are paired and the pairs are named in the
same way until each document is down to one name. How often names are paired depends on the number
of blocks alone, so (number of blocks, last name) is an identity without collisions.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.skew import each_lot, frequent_keys, join_by_key, lot_of, packed, with_lots
from tidemark.session import checkpointed

BLOCK_BYTES = 2048


def normalised(text: str = "text"):
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sorted_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the integer ``name`` in place of ``keys``; equal keys get equal names.

    A name is the place of the first equal row in sorted order. Rows of frequent keys do not meet
    in one task: their distinct keys are named below zero and joined back in lots. Keys must not be null.
    """
    frequent = frequent_keys(rows, keys)
    tagged = rows if frequent is None else with_lots(rows, keys, frequent)
    rare = tagged if frequent is None else tagged.filter(F.col("_lots").isNull()).drop("_lots")
    named = (
        rare.repartition(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("name", F.min("_at").over(W.partitionBy(*keys)))
        .drop("_at", *keys))
    if frequent is None:
        return named
    often = tagged.filter(F.col("_lots").isNotNull())
    table = each_lot(
        often.select(*keys, "_lots").distinct().repartition(*keys).sortWithinPartitions(*keys)
        .withColumn("name", -F.lit(1) - F.monotonically_increasing_id()))
    dealt = often.withColumn("_lot", lot_of(F.struct("doc_id", "sha", "at"))).drop("_lots")
    return named.unionByName(dealt.join(table, [*keys, "_lot"]).drop("_lot", *keys))


def block_identities(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, sha, copies, blocks, name) for each distinct (doc_id, text); copies counts its rows.

    ``sha`` (SHA-256 of the normalised text) only tells rows apart that share a doc_id.
    """
    size = F.lit(block_bytes)
    text = docs.select("doc_id", normalised().cast("binary").alias("bytes"))
    blocks = text.select(
        "doc_id", F.unhex(F.sha2("bytes", 256)).alias("sha"), "bytes",
        F.greatest(F.ceil(F.octet_length("bytes") / size), F.lit(1)).cast("int").alias("blocks"),
    ).select("doc_id", "sha", "blocks", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.substring(F.col("bytes"), i * size + 1, size))).alias("at", "block"))
    names = checkpointed(sorted_names(blocks, ["block"]).groupBy("doc_id", "sha", "blocks", "at", "name").agg(
        F.count(F.lit(1)).alias("copies")))
    most = names.agg(F.max("blocks")).first()[0] or 1
    left = F.col("blocks")
    done = [names.filter(left == 1)]
    while most > 1:
        most, left = (most + 1) // 2, F.ceil(left / 2)
        rest = names.filter(F.col("blocks") > 1) if len(done) == 1 else names.filter(~finished)
        pair = rest.groupBy("doc_id", "sha", "blocks", "copies", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(0)).alias("second"),
            (F.max(F.col("at") % 2) == 1).alias("paired"))
        names = checkpointed(sorted_names(pair, ["first", "second", "paired"]))
        finished = left <= 1
        done.append(names.filter(finished))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("at")


def exact_groups(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest doc_id stays, a null doc_id is smaller than any other (if all
    are null, keep_id is null). A row that occurs several times counts each time, and one of its
    occurrences at most is kept. Other columns of ``docs`` are not read.
    """
    ids = block_identities(docs, block_bytes=block_bytes)
    totals = ids.groupBy("blocks", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = join_by_key(ids, totals, ["blocks", "name"], F.struct("doc_id", "sha"))
    return rows.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("chosen"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("chosen") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all its columns, with one row of each group of equal texts (see ``exact_groups``)."""
    kept = exact_groups(docs, block_bytes=block_bytes).filter("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    rows = packed(docs, _id=F.col("doc_id"), _sha=F.unhex(F.sha2(normalised().cast("binary"), 256)))
    same = F.col("_id").eqNullSafe(kept["doc_id"]) & (F.col("_sha") == kept["sha"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")
