"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: a lost executor costs a re-read, not a recomputation, and ids
given before the write are fixed after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_tracked: list[list[str]] = []  # the paths that each open ``tracking`` has seen written


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The shuffle files of the write are of no more use; Spark deletes them once the driver has
    collected its garbage, which would else happen much later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    for paths in _tracked:
        paths.append(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tracking() -> Iterator[list[str]]:
    """The paths of all tables staged within the block, to be deleted once what reads them is written."""
    paths: list[str] = []
    _tracked.append(paths)
    try:
        yield paths
    finally:
        _tracked[:] = [other for other in _tracked if other is not paths]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; ones that are gone are no error."""
    jvm = spark._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
