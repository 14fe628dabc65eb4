"""Percentiles, scores, guards and verdicts (ST)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.functions.text import clamp01, java_round
from pulsegrid.shared import stage

#: Weights of difficulty 1..5, and what a disagreement leaves of them.
DIFFICULTY_WEIGHTS = (1.0, 2.0, 4.0, 8.0, 16.0)
DISAGREEMENT_FACTOR = 0.3
SESSION_CAP, DAY_CAP = 2_000_000_000, 5_000_000_000


def percentiles(df: DataFrame, keys: Sequence[str], measure: str, points: Sequence[int] = (10, 25, 50, 75, 90)) -> DataFrame:
    """ST-1, ST-2: exact percentiles with linear interpolation, to three decimals."""
    return df.groupBy(*keys).agg(*[java_round(F.percentile(measure, F.lit(p / 100)), 3).alias(f"p{p}") for p in points])


def rank_percentile(df: DataFrame, measure: str, name: str = "rank_pct") -> DataFrame:
    """ST-3: 100 times the share of values not above. Distinct values are ranked, rows only look up theirs."""
    return df.join(value_ranks(df, measure, name), measure)


def value_ranks(df: DataFrame, measure: str, name: str) -> DataFrame:
    """(measure, name) for the distinct values.

    Counts are dealt out by ranges of the value; each range is summed up on its own, after what all ranges before
    it hold: a table with a row for each range, the only thing that is ordered as a whole.
    """
    counts = df.where(F.col(measure).isNotNull()).groupBy(measure).agg(F.count(F.lit(1)).alias("_n"))
    counts = stage(counts.repartitionByRange(measure).withColumn("_range", F.spark_partition_id()), "value_counts")
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    upto = F.sum("_n").over(W.partitionBy("_range").orderBy(measure)) + F.col("_before")
    return counts.join(F.broadcast(ranges), "_range").select(measure, (upto * 100.0 / F.col("_all")).alias(name))


def raw_score(capability: Column, output_pct: Column, completion: Column, revert: Column, commits: Column, challenge: Column, leverage: Column, dependent: Column) -> Column:
    """ST-4: weighted parts between 0 and 1, times 100; the revert term is neutral under three commits."""
    zero = F.lit(0.0)
    calm = F.when((commits >= 3) & revert.isNotNull(), clamp01(1 - revert)).otherwise(0.5)
    quality = 0.6 * clamp01(F.coalesce(completion, zero)) + 0.4 * calm
    independence = clamp01((F.coalesce(leverage, zero) - F.coalesce(dependent, zero) + 1) / 2)
    return (0.35 * clamp01(capability / 5) + 0.25 * clamp01(output_pct) + 0.20 * quality + 0.15 * clamp01(challenge) + 0.05 * independence) * 100


def shrunk(score: Column, mean: Column, n: Column, k: int = 10) -> Column:
    """ST-5: the score drawn towards the mean by k / (n + k); without a mean the score itself."""
    w = n / (n + k)
    return F.when(mean.isNull() | F.isnan(mean), score).otherwise(w * score + (1 - w) * mean)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "S").when(score >= 70, "A").when(score >= 55, "B").when(score >= 40, "C").otherwise("D")


def confidence(n: Column) -> Column:
    return F.when(n >= 20, "normal").otherwise("low")


def flags(rules: dict[str, Column]) -> Column:
    """ST-6: the names of the rules that hold, comma-joined in the order given."""
    return F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in rules.items()])


def difficulty_weight(difficulty: Column, disagreement: Column) -> Column:
    weight = F.element_at(F.array(*[F.lit(w) for w in DIFFICULTY_WEIGHTS]), difficulty)
    return weight * F.when(disagreement, DISAGREEMENT_FACTOR).otherwise(1.0)


def outcome_value(outcome: Column) -> Column:
    return F.when(outcome == "completed", 1.0).when(outcome == "partial", 0.5).otherwise(0.0)


def consensus(a: Column, b: Column) -> tuple[Column, Column]:
    """ST-10: the mean of two judges' integers, halves up, and whether they are more than one apart."""
    return F.floor((a + b) / 2 + 0.5).cast("int"), F.abs(a - b) > 1


def guarded_sum(value: str) -> Column:
    """ST-12: the sum if it is within the day's cap; otherwise bad rows are left out and the rest capped.

    Offsetting bad rows hide in a sum within the cap; that is how the fast path behaves.
    """
    plain = F.sum(value)
    sane = F.sum(F.when(F.col(value).between(0, SESSION_CAP), F.col(value)).otherwise(0))
    return F.when(plain.between(0, DAY_CAP), plain).otherwise(F.least(sane, F.lit(DAY_CAP)))


def accepted_total(value: Column, previous: Column, cap: int = SESSION_CAP) -> Column:
    """ST-13: a plausible total, or the previous one."""
    return F.when(value.between(0, cap), value).otherwise(F.coalesce(previous, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """ST-14: rounded percent; -1 without a whole."""
    return F.when(whole == 0, F.lit(-1)).otherwise(F.floor(part * 100.0 / whole + 0.5)).cast("long")


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """ST-8, ST-17: a / b rounded; null where b is 0."""
    return F.when(b != 0, java_round(a / b, digits))
