"""Writers, keyed upserts, status updates and column encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import contracts as C


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_daily_panel(df: DataFrame, path: str, date_col: str = "date_day") -> None:
    """Replace only the dates present in ``df``.

    The rebalance hint gathers each date's rows and lets adaptive execution split
    large dates and merge small ones, so file sizes follow the data.
    """
    (
        df.hint("rebalance", date_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col)
        .parquet(path)
    )


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows as new files; nothing already written is read or rewritten."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` whose key is not in ``new``, plus all of ``new``."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def complete_actions(
    queue: DataFrame, completions: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Apply completed actions to the queue and produce their audit rows.

    ``completions`` has one row per action: ``action_id, outcome, notes``.
    """
    done = completions.select("action_id", "outcome", "notes")
    joined = queue.join(done, "action_id", "left")
    hit = F.col("outcome").isNotNull()
    updated = joined.withColumns(
        {
            "status": F.when(hit, F.lit("Sent")).otherwise(F.col("status")),
            "processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
        }
    ).select(*queue.columns)
    audit = joined.filter(hit).select(
        F.concat(F.lit("MO"), F.col("action_id")).alias("audit_id"),
        "member_id",
        "hashed_member_id",
        now.alias("sent_at"),
        "action_type",
        F.lit("Sent").alias("status"),
        F.concat(F.lit("Manual Outreach | Outcome: "), F.col("outcome")).alias("why_score"),
        F.concat(F.lit("Outcome: "), F.col("outcome"), F.lit(" | Notes: "),
                 F.coalesce("notes", F.lit(""))).alias("message_body"),
        F.lit("").alias("error_message"),
    )
    return updated, audit.select(*[f.name for f in C.AUDIT_SCHEMA])


def _require_key(key: str | None) -> str:
    if not key:
        raise ValueError("an encryption key is required; refusing to continue without one")
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("the key must be 16, 24 or 32 bytes")
    return key


def encrypt_pii_columns(df: DataFrame, columns: list[str], key: str | None) -> DataFrame:
    """Columns as base64 of AES-GCM. Nulls stay null."""
    secret = F.lit(_require_key(key))
    return df.withColumns(
        {c: F.base64(F.aes_encrypt(F.col(c), secret, F.lit("GCM"))) for c in columns}
    )


def decrypt_pii_columns(df: DataFrame, columns: list[str], key: str | None) -> DataFrame:
    secret = F.lit(_require_key(key))
    return df.withColumns(
        {c: F.aes_decrypt(F.unbase64(F.col(c)), secret, F.lit("GCM")).cast("string") for c in columns}
    )
