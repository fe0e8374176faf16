"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Keys of encrypted columns are literals of the plan; they are not shown.
    "spark.sql.redaction.string.regex": "(?i)(aes_encrypt|aes_decrypt)\\([^)]*\\)",
    # Call-site capture per column expression only slows down plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    ``spark.checkpoint.dir`` if the cluster names one, else one below the warehouse. A local
    warehouse serves only a local master; elsewhere it is an error, as executors would write to
    their own disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is not None:
        return named
    folder = sc._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir")).getFileSystem(
        sc._jsc.hadoopConfiguration()).makeQualified(
        sc._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), "_tidemark")).toString()
    if folder.startswith("file:") and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are sorted and merged, it is never sent to the driver.

    Packed in files or shuffles a table can look small enough to be broadcast and take many times that in the driver.
    """
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder. A frame that is a checkpoint already is returned as it is.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes the files when the frame is no
    longer referenced.
    """
    if getattr(df, "_tidemark_checkpoint", False):
        return df
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    out._tidemark_checkpoint = True
    return out
