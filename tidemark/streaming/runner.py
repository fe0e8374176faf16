"""Run a stream over the files present now and read back what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A parquet table as a file stream with the table's own schema."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, append the results to parquet, return them as a table."""
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_deliveries(deliveries: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Files that arrive one delivery after the other, each followed by a run over one and the same checkpoint.

    The next run takes up the state and the watermark the one before has left, so a row that comes with a
    later delivery than its window allows is late. All deliveries have one schema. What was appended is returned.
    """
    spark = deliveries[0].sparkSession
    base = scratch_dir(spark, name)
    for delivery in deliveries:
        delivery.write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(deliveries[0].schema).parquet(f"{base}/in"))
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
