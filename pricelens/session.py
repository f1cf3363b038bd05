"""Session settings for local runs; a cluster brings its own session."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")  # call sites of every expression cost seconds a plan
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    A local session without one gets a scratch folder, for its executor is this machine; a cluster without one is an
    error, for a folder of one machine would lose rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def materialize(df: DataFrame) -> DataFrame:
    """Writes an intermediate result once, as a table in the shared checkpoint folder, and reads it back.

    Used where one result feeds several branches: it cuts the lineage, survives lost executors, and each branch
    reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pricelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a dimension is sent to every executor.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """A table that is broadcast where a count proves it small, and joined by shuffling beyond that; results are the same."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
