"""Tables written once in the shared folder of the session, so that lost executors cost no lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A counted table of at most so many rows may be broadcast (rows here have two or three fixed-width columns).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="wavepanel-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wavepanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
