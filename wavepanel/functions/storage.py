"""Keeping intermediate tables, and joining with small ones."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000     # counted rows up to which a narrow side is broadcast


def durable(df: DataFrame) -> DataFrame:
    """Keep a reduced table (patterns, cells, brackets) that many jobs read.

    Where the session names a shared checkpoint folder the table is written
    there, so a lost executor costs a re-read and not another scan of the
    source. Otherwise it is persisted and recomputed from its source if lost.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        kept.count()      # made at its own width, before a reader asks for fewer partitions
        return kept
    written = kept.checkpoint()
    kept.unpersist()
    return written.persist(StorageLevel.MEMORY_AND_DISK)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; beyond that Spark and AQE choose the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="wavepanel-")
