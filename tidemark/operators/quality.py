"""Data-quality, privacy and consent checks. Checks return DataFrames of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark import contracts as C
from tidemark.functions.expressions import count_when, either


def dq_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the columns (one row)."""
    return df.agg(F.coalesce(
        count_when(either([F.col(c).isNull() for c in columns])), F.lit(0)).alias("null_rows"))


def dq_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of repeated values per key column, one line per column."""
    parts = [
        df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .agg(F.count(F.lit(1)).alias("duplicates"))
        .select(F.lit(k).alias("key"), "duplicates")
        for k in keys
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_range(
    features: DataFrame, *, min_age: float = 14, max_age: float = 100,
    rates: tuple[str, ...] = ("attendance_rate_7d", "attendance_rate_30d", "email_open_rate_30d"),
) -> DataFrame:
    """Out-of-range rows per rule, in one pass."""
    bad_rate = either([(F.col(r) < 0) | (F.col(r) > 1) for r in rates])
    zero = F.lit(0)
    return features.agg(
        F.coalesce(count_when((F.col("age") < min_age) | (F.col("age") > max_age)), zero).alias("invalid_age"),
        F.coalesce(count_when(bad_rate), zero).alias("invalid_rates"),
        F.coalesce(count_when(F.col("days_since_last_session") < 0), zero).alias("invalid_idle"),
    )


def label_distribution(features: DataFrame, label: str = C.LABEL) -> DataFrame:
    return features.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def dq_label_binary(features: DataFrame, label: str = C.LABEL) -> DataFrame:
    n = F.countDistinct(label) + F.max(F.col(label).isNull().cast("int"))
    return features.agg(n.alias("label_values"), (n == 2).alias("is_binary"))


def dq_pii_columns(df: DataFrame, forbidden: list[str] = C.PII_COLUMNS) -> DataFrame:
    """Forbidden column names present in the schema; no data is read."""
    found = [(c,) for c in df.columns if c.lower() in forbidden]
    return df.sparkSession.createDataFrame(found, "leaked_column string")


def dq_pii_values(features: DataFrame, identity: DataFrame) -> DataFrame:
    """Text values of the table that equal a name, email or phone (one row).

    Both sides are reduced to distinct values before they meet; the count of
    occurrences travels with the value.
    """
    text = [f.name for f in features.schema if isinstance(f.dataType, T.StringType)]
    values = (
        features.select(F.explode(F.array(*[F.col(c) for c in text])).alias("v"))
        .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    pii = identity.select(F.explode(F.array("name", "email", "phone")).alias("v")).distinct()
    return values.join(pii, "v", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("leaked_values"))


# Every foreign key of the raw tables.
FOREIGN_KEYS = [
    ("members", "home_studio_id", "studios", "studio_id"),
    ("memberships", "member_id", "members", "member_id"),
    ("memberships", "studio_id", "studios", "studio_id"),
    ("sessions", "member_id", "members", "member_id"),
    ("sessions", "studio_id", "studios", "studio_id"),
    ("transactions", "member_id", "members", "member_id"),
    ("transactions", "studio_id", "studios", "studio_id"),
    ("app_events", "member_id", "members", "member_id"),
    ("ai_coach_chats", "member_id", "members", "member_id"),
    ("email_events", "member_id", "members", "member_id"),
    ("ground_truth", "member_id", "members", "member_id"),
]


def dq_foreign_keys(
    tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]] = FOREIGN_KEYS
) -> DataFrame:
    """Unresolved rows per foreign key. Keys are counted before the anti join, so a hot key
    crosses the shuffle once per task."""
    parts = []
    for child, fk, parent, pk in keys:
        used = tables[child].groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        known = tables[parent].select(F.col(pk).alias("k")).distinct()
        parts.append(
            used.join(known, "k", "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
            .select(F.lit(f"{child}.{fk}").alias("foreign_key"), "orphans")
        )
    return reduce(DataFrame.unionByName, parts)


def dq_row_counts(
    tables: dict[str, DataFrame], expected: dict[str, int] | None = None
) -> DataFrame:
    """Rows per table and whether all rows carry the constant flag."""
    expected = expected or {}
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.bool_and("is_synthetic"), F.lit(True)).alias("flag_constant"),
        ).select(
            F.lit(name).alias("table_name"), "rows", "flag_constant",
            (F.col("rows") == expected[name] if name in expected else F.lit(True)).alias("as_expected"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_signal_coverage(
    ground_truth: DataFrame, transactions: DataFrame, *, cohort: str = "sudden_drop",
    status: str = "Failed", minimum: float = 0.99,
) -> DataFrame:
    """Share of a cohort's members with at least one failed payment (one row)."""
    failed = transactions.filter(F.col("status") == status).select("member_id").distinct().withColumn(
        "hit", F.lit(1))
    share = F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0))
    return (
        ground_truth.filter(F.col("cohort") == cohort).select("member_id").distinct()
        .join(failed, "member_id", "left")
        .agg(
            F.count(F.lit(1)).alias("cohort_members"),
            F.coalesce(F.sum("hit"), F.lit(0)).alias("with_signal"),
            F.round(share, 6).alias("coverage"),
            (share >= minimum).alias("passes"),
        )
    )


def dq_freshness(
    feeds: dict[str, tuple[DataFrame, str]], *, now: Column, sla_hours: float = 24.0
) -> DataFrame:
    """Latest record per feed against its service level."""
    parts = [
        df.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("latest")).select(
            F.lit(name).alias("feed"), "latest",
            (F.col("latest") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(sla_hours * 60)))).alias("fresh"),
        )
        for name, (df, ts) in feeds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_volume_anomaly(df: DataFrame, day: Column, *, z_limit: float = 3.0) -> DataFrame:
    """Daily row counts with their z-score against all days; one row per calendar day."""
    counts = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    stats = counts.agg(F.struct(F.avg("rows").alias("m"), F.stddev_pop("rows").alias("s"))).scalar()
    z = F.when(F.col("__s.s") > 0, (F.col("rows") - F.col("__s.m")) / F.col("__s.s")).otherwise(0.0)
    return (
        counts.withColumn("__s", stats).withColumn("z", F.round(z, 6)).drop("__s")
        .withColumn("anomaly", F.abs("z") > z_limit)
    )


def apply_opt_out(df: DataFrame, opted_out: DataFrame, key: str = "member_id") -> DataFrame:
    """Rows of people who did not opt out."""
    return df.join(opted_out.select(key).distinct(), key, "left_anti")


def erase_members(tables: dict[str, DataFrame], erased: DataFrame) -> dict[str, DataFrame]:
    """Every table without the erased people; tables are keyed by member or hashed id.

    ``erased`` holds ``member_id`` and ``hashed_member_id``.
    """
    out = {}
    for name, df in tables.items():
        key = "member_id" if "member_id" in df.columns else "hashed_member_id"
        out[name] = apply_opt_out(df, erased, key) if key in df.columns else df
    return out
