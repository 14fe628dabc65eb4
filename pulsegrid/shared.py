"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Bytes of Parquet that one task reads, or that make one partition more in a shuffle; columns as small as keys and dates take ten times that and more in memory.
SPLIT, SHARE = 16 << 20, 2 << 20
SPLITS, PARTITIONS, LEAST = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def dealt_out(spark: SparkSession, path: str) -> None:
    """Let tasks and shuffles of this session be as many as the table at ``path`` needs, so that what one task holds does not grow with it.

    A session whose settings deal out finer keeps them; the number of partitions of a shuffle is only where adaptive execution starts from.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    needed = (fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0) // SHARE
    if needed <= int(spark.conf.get(PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        return
    spark.conf.set(PARTITIONS, str(needed))
    for name in (SPLITS, LEAST):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > SPLIT:
            spark.conf.set(name, str(SPLIT))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application; nothing else uses it."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its plan is cut, and what it holds no longer changes."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[..., DataFrame]]:
    """A ``stage`` whose tables are there within the block only; ``parts`` are columns by which a table has folders of its own.

    The shuffle files of a write are of no more use after it; Spark deletes them once the driver has collected its garbage.
    """
    folder = own_folder(spark, name)

    def stage(df: DataFrame, what: str, *parts: str) -> DataFrame:
        path = f"{folder}/{what}-{uuid4().hex}"
        df.write.partitionBy(*parts).parquet(path, compression="zstd")
        spark._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()
