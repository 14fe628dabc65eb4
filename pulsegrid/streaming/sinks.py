"""Sinks for micro-batches: keep-latest merge, append once, recompute affected days (SNK, STR-9, MAT-5..7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.shared import own_folder, stage


def keep_latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """SNK-1: one row per natural key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged(stored: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """SNK-1: stored rows with newer ones of the batch in their place; equal versions leave the stored row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, F.desc(version), F.asc("_new")).drop("_new")


def not_stored(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK-2..4: rows of the batch, one per key, that are not stored yet."""
    return batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def richer(stored: DataFrame, batch: DataFrame, keys: Sequence[str], *richness: str) -> DataFrame:
    """SNK-5: of stored and incoming rows the one with more detail; ties leave the stored row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, *[F.desc(c) for c in richness], F.asc("_new")).drop("_new")


def overwrite_days(df: DataFrame, path: str, day: str = "work_date") -> None:
    """SNK-6, SNK-7: replace exactly the days that ``df`` has; other partitions stay."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def recompute_affected(build: Callable[[DataFrame], DataFrame], read: Callable[[SparkSession], DataFrame], path: str, at: str, day: str = "work_date") -> Callable[[DataFrame, int], None]:
    """STR-9: a foreachBatch function: late rows rebuild the days they fall in, from all rows of those days.

    The same batch twice gives the same days, so a retry is harmless.
    """

    def run(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date(at).alias("_day")).distinct()
        rows = read(batch.sparkSession).withColumn("_day", F.to_date(at)).join(days, "_day", "left_semi").drop("_day")
        overwrite_days(build(rows), path, day)

    return run


def stale_days(events: DataFrame, summary: DataFrame, at: str = "event_time", day: str = "work_date", updated: str = "updated_time") -> DataFrame:
    """MAT-6: days whose newest event is newer than their summary, that have no summary, or only a summary."""
    newest = events.groupBy(F.to_date(at).alias(day)).agg(F.max(at).alias("_newest"))
    built = summary.groupBy(day).agg(F.max(updated).alias("_built"))
    return newest.join(built, day, "full").where("_newest is null or _built is null or _newest > _built").select(day)


def without_content(df: DataFrame, at: str, before: str, columns: Sequence[str]) -> DataFrame:
    """MAT-7: rows stay, the content of old ones goes."""
    old = F.col(at) < F.lit(before).cast("timestamp_ntz")
    return df.withColumns({c: F.when(~old, F.col(c)) for c in columns})


def rewritten(first: DataFrame, again: DataFrame, day: str = "work_date") -> DataFrame:
    """SNK-6, SNK-7: a table by day written from ``first``, of which the days of ``again`` are then replaced; read back."""
    spark, path = first.sparkSession, own_folder(first.sparkSession, "by_day")
    overwrite_days(first, path, day)
    overwrite_days(again, path, day)
    return spark.read.schema(first.schema).parquet(path)


def content_addressed(rows: DataFrame, row_id: str, content: str, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-4: (digest, content) of contents that are not stored yet or were emptied, and (row, digest) links; null contents have none."""
    linked = rows.where(F.col(content).isNotNull()).select(row_id, F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(content).alias("content"))
    blobs = linked.groupBy("digest").agg(F.first("content").alias("content"))
    if stored is not None:
        blobs = blobs.join(stored.where(F.col("content").isNotNull()).select("digest"), "digest", "left_anti")
    return blobs, linked.select(row_id, "digest")


def updated_if_changed(stored: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """MAT-8: stored rows with the new values, and whether any differs; rows without new values stay."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = stored.join(fresh, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = F.coalesce(F.col("_new"), F.lit(False)) & differs
    values = {c: F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return both.withColumn("changed", changed).withColumns(values).select(*stored.columns, "changed")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")


def pushed(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-8: counts that a subscriber sums up from the micro-batches it is handed; a batch that comes twice counts once."""
    out, state = own_folder(spark, "pushed"), own_folder(spark, "pushed_state")

    def push(batch: DataFrame, n: int) -> None:
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{out}/batch={n}")

    _events(spark, folder).writeStream.foreachBatch(push).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("count").alias("n"))


def spooled(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-10: a stream to files and back, run twice from one checkpoint; the second run finds nothing new."""
    out, state = own_folder(spark, "spool"), own_folder(spark, "spool_state")
    for _ in range(2):
        stream = _events(spark, folder).select("event_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def resumed(spark: SparkSession, items: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], path: str, rounds: int = 3, at_once: int = 1_000) -> DataFrame:
    """MAT-5: a back-fill by ``key`` that can be stopped: what a progress table names as done is not done again.

    Each round takes up to ``at_once`` of the keys that are left, in order, and writes their results and then their names. A round
    that fails is tried again up to ``rounds`` times; then its error is raised, and a later call goes on from there.
    """
    done_path = f"{path}_done"
    while True:
        done = _read(spark, done_path, items.select(key))
        left = items.select(key).distinct().join(done, key, "left_anti").orderBy(key).limit(at_once)
        chosen = stage(left, "backfill")
        if chosen.isEmpty():
            return spark.read.parquet(path)
        for attempt in range(rounds):
            try:
                overwrite_days(build(items.join(chosen, key, "left_semi")), path, key)
                break
            except Exception:
                if attempt == rounds - 1:
                    raise
        chosen.write.mode("append").parquet(done_path)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return like.where("false")
