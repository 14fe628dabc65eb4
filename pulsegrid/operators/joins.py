"""Joins that are more than an equality: bands, as-of, latest of a group, absence (JN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.shared import stage

LONG = 32


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _bucketed(points: DataFrame, intervals: DataFrame, keys: dict[str, str], at: str, how: str, seconds: int) -> DataFrame:
    """The join with buckets of one width; intervals have _from and _to."""
    left = points.withColumn("_bucket", F.floor(_epoch(F.col(at)) / seconds))
    touched = F.sequence(F.floor(_epoch(F.col("_from")) / seconds), F.floor(_epoch(F.col("_to")) / seconds))
    right = intervals.where("_from <= _to").withColumn("_slot", F.explode(touched))
    same = (F.col("_bucket") == F.col("_slot")) & F.col(at).between(F.col("_from"), F.col("_to"))
    for a, b in keys.items():
        same = same & (left[a] == right[b])
    return left.join(right, same, how).drop("_bucket", "_slot", "_from", "_to")


def band(points: DataFrame, intervals: DataFrame, keys: dict[str, str], at: str, start: Column, end: Column, how: str = "inner", seconds: int = 86_400) -> DataFrame:
    """Points within intervals of the same keys (``how``: inner or left_semi).

    Both sides are dealt to time buckets, so the join is an equality on keys and bucket: a key with
    very many rows is spread over its buckets. A point has one bucket, so no pair comes up twice. Intervals of more
    than ``LONG`` buckets are joined apart, with buckets ``LONG`` ** 2 times as wide, so a wrong start date makes no thousands of rows.
    """
    every = intervals.withColumns({"_from": start, "_to": end})
    long = _epoch(F.col("_to")) - _epoch(F.col("_from")) > LONG * seconds
    short_ones, long_ones = every.where(~long), every.where(long)
    if how == "inner":
        return _bucketed(points, short_ones, keys, at, how, seconds).unionByName(_bucketed(points, long_ones, keys, at, how, seconds * LONG * LONG))
    if how != "left_semi":
        raise ValueError(f"no band join {how}")
    rest = _bucketed(points, short_ones, keys, at, "left_anti", seconds)
    return _bucketed(points, short_ones, keys, at, how, seconds).unionByName(_bucketed(rest, long_ones, keys, at, how, seconds * LONG * LONG))


def missing(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows without a partner."""
    return df.join(other, on, "left_anti")


def roots(links: DataFrame, child: str = "child", parent: str = "parent", promote_orphans: bool = True) -> DataFrame:
    """(child, root) along parent links, however long the chains.

    Pointer jumping: each round doubles how far a node sees, until no pointer moves, so a chain of n links takes log2(n) rounds; every round
    is staged. A node on a cycle, or one whose links lead into a cycle, is its own root. A parent that is nobody's child
    is a root; with ``promote_orphans`` off, such links count as none, and their children are roots themselves. A child with several parents keeps the least.
    """
    known = links.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("to"))
    if not promote_orphans:
        known = known.join(links.select(F.col(child).alias("to")).distinct(), "to", "left_semi").select("node", "to")
    up = stage(known, "roots")
    size, rounds = up.count(), 0
    while size >> rounds:  # a path of more steps than there are nodes is a cycle
        step = up.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        up = stage(up.join(step, up["to"] == step["_n"], "left").select("node", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), "roots")
        rounds += 1
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    # what still has somewhere to go after as many steps as there are nodes goes round
    step = up.select(F.col("node").alias("_n"))
    return up.join(step, up["to"] == step["_n"], "left").select(F.col("node").alias("child"), F.when(F.col("_n").isNull(), F.col("to")).otherwise(F.col("node")).alias("root"))
