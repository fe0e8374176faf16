"""Joins and groups by a key that may hold a large part of all rows."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import checkpointed

# A key with more rows than this is frequent; its rows are dealt out in lots of about LOT_ROWS.
FREQUENT_ROWS = 64
LOT_ROWS = 256
# The list of frequent keys is broadcast; it holds two longs per key and never more keys than this.
LIST_LIMIT = 1 << 18


def packed(docs: DataFrame, **derived: Column) -> DataFrame:
    """``docs`` as one struct column ``_row``, so that derived columns cannot clash with its own."""
    return docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in derived.items()))


def frequent_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Hashes of the frequent keys with the number of lots for each, or None if there are none.

    Only hashes and counts are shuffled, after map-side sums.
    """
    return _listed(rows.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count(F.lit(1)).alias("_n")))


def _listed(counts: DataFrame) -> DataFrame | None:
    """The list for (_hash, _n) counts.

    When more than ``LIST_LIMIT`` keys pass ``FREQUENT_ROWS``, the limit is doubled until the list
    fits; the keys left out are then less frequent than about one in ``LIST_LIMIT`` of all rows.
    """
    counts = checkpointed(counts.filter(F.col("_n") > FREQUENT_ROWS))
    by_size = sorted(
        (r["size"], r["keys"]) for r in
        counts.groupBy(F.floor(F.log2(F.col("_n") - 1)).alias("size")).agg(F.count(F.lit(1)).alias("keys")).collect())
    if not by_size:
        return None
    listed, limit = sum(n for _, n in by_size), FREQUENT_ROWS
    for size, n in by_size:
        if listed <= LIST_LIMIT:
            break
        listed, limit = listed - n, 1 << (size + 1)
    if not listed:
        return None
    return counts.filter(F.col("_n") > limit).select(
        "_hash", F.ceil(F.col("_n") / F.lit(max(LOT_ROWS, limit))).cast("int").alias("_lots"))


def with_lots(rows: DataFrame, keys: list[str], frequent: DataFrame) -> DataFrame:
    """Rows with ``_lots``, the number of lots of their key; null for keys that are not frequent."""
    return rows.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(frequent), "_hash", "left").drop("_hash")


def lot_of(spread: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(spread), F.col("_lots")), F.lit(0))


def each_lot(table: DataFrame) -> DataFrame:
    """A row of a per-key table for each lot of its key."""
    return table.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_lots"), F.lit(1)) - F.lit(1).cast("long")))).drop("_lots")


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                sizes: str | None = None) -> DataFrame:
    """Join rows with a table of one row per key; the rows of a frequent key go to several tasks.

    ``spread`` tells rows of one key apart (an id). Keys must not be null. If a column of ``table``
    has the number of rows of its key, ``sizes`` names it and the rows need not be counted.
    """
    frequent = frequent_keys(rows, keys) if sizes is None else _listed(
        table.select(F.xxhash64(*keys).alias("_hash"), F.col(sizes).cast("long").alias("_n")))
    if frequent is None:
        return rows.join(table, keys, how)
    left = with_lots(rows, keys, frequent).withColumn("_lot", lot_of(spread)).drop("_lots")
    right = each_lot(with_lots(table, keys, frequent))
    return left.join(right, [*keys, "_lot"], how).drop("_lot")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of frames that are no longer referenced.

    It does so when the driver collects its garbage, which on a large job may be long after they are of use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
