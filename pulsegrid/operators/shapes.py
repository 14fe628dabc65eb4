"""Gap filling, matrices, pivots and shares (FN-G)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def clamp_days(days: int) -> int:
    return max(1, min(90, days))


def last_day(start: str, end: str, most: int) -> str:
    """The end of a window from ``start`` of at most ``most`` days; ends in the wrong order are swapped."""
    first, last = sorted(map(date.fromisoformat, (start, end)))
    return min(last, first + timedelta(days=most - 1)).isoformat()


def iso_week(ts: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week of a moment."""
    monday = F.date_trunc("week", ts.cast("timestamp")).cast("date")
    return monday, F.date_add(monday, 6)


def day_axis(df: DataFrame, start: str, end: str, name: str = "day") -> DataFrame:
    """All days from start to end."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name))


def gap_filled(df: DataFrame, day: str, measures: Sequence[str], start: str, end: str) -> DataFrame:
    """FN-G1: a row for each day of the range, with zeros where there was none."""
    return day_axis(df, start, end, day).join(df, day, "left").fillna(0, list(measures))


def top_grid(df: DataFrame, day: str, name: str, measure: str, start: str, end: str, n: int = 8) -> DataFrame:
    """FN-G2: cells of the n names with the greatest totals, on a full axis of days; place and day index as coordinates."""
    totals = df.groupBy(name).agg(F.sum(measure).alias("_t")).orderBy(F.desc("_t"), name).limit(n)
    ranked = totals.withColumn("place", (F.row_number().over(W.orderBy(F.desc("_t"), name)) - 1).cast("long")).drop("_t")  # n rows
    axis = day_axis(df, start, end, day).withColumn("day_index", F.date_diff(day, F.lit(start).cast("date")).cast("long"))
    grid = F.broadcast(ranked).crossJoin(F.broadcast(axis))  # n names by the days of the window
    return grid.join(df, [name, day], "left").fillna(0, [measure])


def matrix(df: DataFrame, row: str, column: str, measure: str, rows: int = 20, columns: int = 20) -> DataFrame:
    """FN-G3: [row index, column index, value] of the rows and columns with the greatest totals."""

    def axis(key: str, index: str, n: int) -> DataFrame:
        totals = df.groupBy(key).agg(F.sum(measure).alias("_t")).orderBy(F.desc("_t"), key).limit(n)
        return F.broadcast(totals.withColumn(index, (F.row_number().over(W.orderBy(F.desc("_t"), key)) - 1).cast("long")).drop("_t"))

    return df.join(axis(row, "row_index", rows), row).join(axis(column, "column_index", columns), column)


def pivot_by(df: DataFrame, rows: Sequence[str], columns: Sequence[str], measures: dict[str, str], always: Sequence[str] = (), only: dict[str, object] | None = None) -> DataFrame:
    """FN-G4: groups of the chosen dimensions and of those that are ``always`` there, with '' for a missing value; a filter without a value is none."""
    for name, value in (only or {}).items():
        df = df.where(F.col(name) == F.lit(value)) if value is not None else df
    dims = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*rows, *columns, *always]]
    return df.groupBy(*dims).agg(*[F.expr(e).alias(k) for k, e in measures.items()])


def share_of_total(df: DataFrame, measure: str, name: str = "share_pct") -> DataFrame:
    """FN-G7: percent of the total to one decimal; a total of zero divides by one. The total is a one-row join."""
    total = df.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("_total"))
    safe = F.when(F.col("_total") == 0, 1).otherwise(F.col("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.floor(F.col(measure) * 1000.0 / safe + 0.5) / 10).drop("_total")


def with_other(df: DataFrame, name: str, kind: str, measure: str, keep: int = 22) -> DataFrame:
    """SRT-8: the ``keep`` greatest stay, the rest are summed in one row for each kind."""
    top = df.orderBy(F.desc(measure), name).limit(keep).select(F.col(name).alias("_top"))
    marked = df.join(F.broadcast(top), F.col(name) == F.col("_top"), "left")
    label: Column = F.coalesce("_top", F.concat(F.lit("other:"), kind))
    return marked.groupBy(label.alias(name), kind).agg(F.sum(measure).alias(measure))
