"""Readers: parquet tables, a SQL database, and the append-only auth log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark import contracts as C


def read_table(
    spark: SparkSession, directory: str, table: str, columns: list[str] | None = None
) -> DataFrame:
    """One parquet table; only ``columns`` reach the scan."""
    df = spark.read.parquet(f"{directory}/{table}.parquet")
    return df.select(*columns) if columns else df


def register_sources(
    spark: SparkSession, directory: str, tables: list[str], prefix: str = "raw_"
) -> dict[str, DataFrame]:
    """Temp views over raw tables. A missing file fails here, when the schema is read."""
    frames = {t: read_table(spark, directory, t) for t in tables}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return frames


def load_table(
    spark: SparkSession,
    table: str,
    *,
    mode: str = "parquet",
    directory: str | None = None,
    url: str | None = None,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int = 200,
) -> DataFrame:
    """Parquet or JDBC, chosen by ``mode``; unconfigured sources fail loudly.

    A JDBC read is split by ``partition_column`` when its bounds are given;
    otherwise the database delivers it through one connection.
    """
    if mode == "parquet":
        if not directory:
            raise ValueError("parquet mode needs a directory")
        return read_table(spark, directory, table)
    if mode != "jdbc":
        raise ValueError(f"unknown source mode: {mode}")
    if not url:
        raise ValueError("jdbc mode needs a connection url")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is not None:
        if lower_bound is None or upper_bound is None:
            raise ValueError("a partitioned jdbc read needs both bounds")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", num_partitions)
        )
    return reader.load()


def stage(df: DataFrame, table: str) -> DataFrame:
    """Project a raw table to its contract: named columns, contract types, contract order."""
    schema = C.RAW_TABLES[table]
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def empty_table(spark: SparkSession, schema) -> DataFrame:
    """A typed table with no rows, for a log that does not exist yet."""
    return spark.createDataFrame([], schema)


def mark_synthetic(df: DataFrame, value: str = "true") -> DataFrame:
    """Attach a SYNTHETIC_DATA note to every column; parquet keeps it in the file schema."""
    return df.select(
        *[F.col(n).alias(n, metadata={"SYNTHETIC_DATA": value}) for n in df.columns]
    )


def synthetic_marks(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata.get("SYNTHETIC_DATA", "NONE") for f in df.schema}


def read_auth_log(spark: SparkSession, path: str, keep_malformed: bool = False) -> DataFrame:
    """JSON-lines auth events; malformed lines are dropped unless asked for."""
    schema = T.StructType([*C.AUTH_LOG_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if keep_malformed:
        return df
    return df.filter(F.col("_corrupt_record").isNull() & F.col("ts").isNotNull()).drop("_corrupt_record")
