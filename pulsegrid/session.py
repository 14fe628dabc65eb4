"""Session settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every job of the engine runs with; a cluster may raise the sizes, not the semantics.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(app: str = "pulsegrid", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the existing session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
