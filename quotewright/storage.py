"""Intermediate tables in the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quotewright-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and read it back.

    Cuts lineage at the cost of one write; the files survive the loss of any executor.  They stay until
    ``discard`` or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once all that read them has been written itself."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            sc = table.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
