"""Exact global ranks, running totals and quantiles without a one-task sort.

Values are split into buckets by a quantile sketch. The number of buckets and the
sketch's accuracy follow the number of rows, up to ``MOST_BUCKETS``. Bucket totals
give each bucket its starting offset, and the exact order is resolved inside buckets in
parallel. Rows with equal values are split further by a hashed tie-break, so
one value held by a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import checkpointed, shuffled

_B, _S, _OFF = "__bucket", "__sub", "__offset"
# Rows a bucket is meant for, and the least and most buckets. The most bounds the offset tables
# (257 rows a bucket) and with them what is broadcast.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 64, 4_096


def bucket_count(rows: DataFrame) -> int:
    """Buckets for a materialised frame."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-rows.count() // BUCKET_ROWS)))


def _accuracy(buckets: int) -> int:
    return max(2_000, 10 * buckets)


def _bucket_index(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda edge: edge < value))


def _search(edges: list, value: Column, low: int = 0, high: int | None = None) -> Column:
    """Number of edges below the value, as nested comparisons (a binary search)."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value > F.lit(edges[mid]), _search(edges, value, mid + 1, high)).otherwise(
        _search(edges, value, low, mid)
    )


def _bucket_of(edges: list, value: Column, coarse: int = 64) -> Column:
    """Number of edges below the value: a search over every n-th edge, then within its stretch."""
    if len(edges) <= coarse:
        return _search(edges, value)
    step = -(-len(edges) // coarse)
    parts = [edges[i:i + step] for i in range(0, len(edges), step)]
    part = _search([p[-1] for p in parts[:-1]], value)
    rest = F.element_at(F.array(*[F.array(*[F.lit(e) for e in p]) for p in parts]), part + 1)
    return part * step + _bucket_index(rest, value)


def _edges(df: DataFrame, value: str, buckets: int) -> list:
    """Cut points from a sketch. They are fetched once, so every later pass,
    and every retried task, cuts the rows in the same places."""
    grid = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(value), grid, _accuracy(buckets))).first()[0]
    return sorted(set(found or []))


def _with_bucket(df: DataFrame, value: str, buckets: int | None) -> DataFrame:
    edges = _edges(df, value, buckets or bucket_count(df))
    return df.withColumn(_B, _bucket_of(edges, F.col(value)))


def in_ranges(df: DataFrame, value: str, *, out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of the range its numeric ``value`` falls in; ranges have about equal numbers of rows.

    Equal values are in one range, and ranges are numbered in the order of values. The rows are materialised, as
    they are read twice.
    """
    return _with_bucket(checkpointed(df), value, ranges).withColumnRenamed(_B, out)


def global_row_number(
    df: DataFrame, value: str, tiebreak: str, *, descending: bool = False,
    out: str = "row_number", buckets: int | None = None,
) -> DataFrame:
    """1-based position of each row by ``value`` then ``tiebreak``.

    ``tiebreak`` must be a unique hash in hex (for instance sha-256 of the key).
    A value frequent enough to fill a bucket is one of the cut points; rows
    equal to a cut point are split further by the first two digits of the hash,
    which keeps their order. Pass only the columns needed: the rows are
    materialised once and read three times.
    """
    rows = checkpointed(df)
    edges = _edges(rows, value, buckets or bucket_count(rows))
    v = F.col(value)
    on_edge = v.isin(edges) if edges else F.lit(False)
    digits = F.conv(F.substring(tiebreak, 1, 2), 16, 10).cast("int")
    # Rows on a bucket's upper cut point come last in it, or first when descending.
    marked = rows.withColumn(_B, _bucket_of(edges, v) * (-1 if descending else 1)).withColumn(
        _S, F.when(on_edge, digits).otherwise(256 if descending else -1)
    )
    before = W.partitionBy(F.lit(1)).orderBy(_B, _S).rowsBetween(W.unboundedPreceding, -1)
    # At most buckets * 257 rows: safe on one task and safe to broadcast.
    offsets = (
        marked.groupBy(_B, _S).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(_OFF, F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    order = F.desc(value) if descending else F.asc(value)
    inside = W.partitionBy(_B, _S).orderBy(order, F.asc(tiebreak))
    return (
        marked.join(F.broadcast(offsets), [_B, _S])
        .withColumn(out, F.col(_OFF) + F.row_number().over(inside))
        .drop(_B, _S, _OFF)
    )


def group_row_number(
    df: DataFrame, group: list[str], order: str, *, out: str = "row_number", buckets: int | None = None,
) -> DataFrame:
    """row_number per group by a unique numeric ``order``; hot groups are split by order range."""
    return row_number_in_ranges(_with_bucket(checkpointed(df), order, buckets), group, order, _B, out=out).drop(_B)


def row_number_in_ranges(df: DataFrame, group: list[str], order: str, ranges: str, *, out: str) -> DataFrame:
    """row_number per group by a unique ``order`` whose ranges (``in_ranges``) are numbered in column ``ranges``."""
    before = W.partitionBy(*group).orderBy(ranges).rowsBetween(W.unboundedPreceding, -1)
    # At most as many rows per group as there are ranges.
    offsets = (
        df.groupBy(*group, ranges).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(_OFF, F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = W.partitionBy(*group, ranges).orderBy(order)
    return (
        df.withColumn("__rn", F.row_number().over(inside))
        .join(shuffled(offsets), [*group, ranges])
        .withColumn(out, F.col(_OFF) + F.col("__rn"))
        .drop("__rn", _OFF)
    )


def running_totals(
    df: DataFrame, key: str, measures: list[str], *, descending: bool = False, buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums over a unique numeric ``key``; adds ``cum_<measure>``."""
    sign = -1 if descending else 1
    marked = _with_bucket(checkpointed(df), key, buckets).withColumn(_B, F.col(_B) * sign)
    before = W.partitionBy(F.lit(1)).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    # At most ``buckets`` rows.
    starts = marked.groupBy(_B).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    starts = starts.select(
        _B, *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures]
    )
    order = F.desc(key) if descending else F.asc(key)
    inside = W.partitionBy(_B).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = marked.join(F.broadcast(starts), [_B])
    out = out.withColumns(
        {f"cum_{m}": F.col(f"__o_{m}") + F.sum(m).over(inside) for m in measures}
    )
    return out.drop(_B, *[f"__o_{m}" for m in measures])


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: list[float], *,
    weight: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group: columns group, ``prob``, ``quantile``, ``n``.

    ``weight`` names a count column when ``df`` already has one row per value; such a
    frame should be materialised, as it is read several times.

    Equal values are first counted, a sketch cuts the distinct values into
    buckets, and only the buckets that hold a wanted position are sorted.
    """
    known = df.filter(F.col(value).isNotNull())
    v = F.col(value).cast("double").alias("__v")
    if weight is None:
        counted = checkpointed(known.groupBy(*group, v).agg(F.count(F.lit(1)).alias("__n")))
    else:
        counted = known.select(*group, v, F.col(weight).alias("__n"))
    buckets = buckets or bucket_count(counted)
    grid = [i / buckets for i in range(1, buckets)]
    # One row per group: groups are features or a constant, so the sketch is small whatever the rows.
    sketch = counted.groupBy(*group).agg(
        F.percentile_approx("__v", grid, _accuracy(buckets)).alias("__bounds")
    )
    marked = counted.join(F.broadcast(sketch), group).withColumn(
        _B, _bucket_index(F.col("__bounds"), F.col("__v"))
    ).drop("__bounds")
    in_group = W.partitionBy(*group)
    upto = in_group.orderBy(_B).rowsBetween(W.unboundedPreceding, 0)
    # At most ``buckets`` rows per group.
    spans = (
        marked.groupBy(*group, _B).agg(F.sum("__n").alias("__bn"))
        .withColumn("__hi", F.sum("__bn").over(upto))
        .withColumn("__lo", F.col("__hi") - F.col("__bn"))
        .withColumn("n", F.sum("__bn").over(in_group))
    )
    wanted = spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("__pos", (F.col("n") - 1) * F.col("prob"))
    wanted = wanted.withColumn(
        "__k", F.explode(F.array(F.floor("__pos"), F.ceil("__pos")))
    ).filter((F.col("__k") >= F.col("__lo")) & (F.col("__k") < F.col("__hi")))
    inside = W.partitionBy(*group, _B).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    targets = wanted.select(*group, _B, "prob", "__pos", "__k", "__lo", "n").distinct()
    inside_rows = (
        marked.join(targets.select(*group, _B).distinct(), [*group, _B], "left_semi")
        .withColumn("__top", F.sum("__n").over(inside))
    )
    hits = inside_rows.join(targets, [*group, _B]).filter(
        (F.col("__k") - F.col("__lo") < F.col("__top"))
        & (F.col("__k") - F.col("__lo") >= F.col("__top") - F.col("__n"))
    )
    return (
        hits.groupBy(*group, "prob", "n", "__pos")
        .agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        .withColumn(
            "quantile",
            F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__pos") - F.floor("__pos")),
        )
        .select(*group, "prob", "quantile", "n")
    )
