"""Operators on ordered signals: gaps, islands, state durations, turns (WIN)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.shared import stage

from .joins import roots


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def activity_intervals(signals: DataFrame, keys: Sequence[str], at: str = "signal_time", idle_minutes: int = 30, fill_minutes: int = 5) -> DataFrame:
    """Per day and key, [start, end) in microseconds of what each gap between signals is credited with.

    A gap of nothing or over ``idle_minutes`` counts as none; others count up to ``fill_minutes``, and
    none beyond the day.
    """
    days = signals.select(*keys, F.to_date(at).alias("day"), micros(F.col(at)).alias("t"), micros(F.date_add(F.to_date(at), 1).cast("timestamp_ntz")).alias("midnight"))
    before = F.lag("t").over(W.partitionBy(*keys, "day").orderBy("t"))
    # milliseconds decide, as a clock with that resolution would show them
    gap = F.floor(F.col("t") / 1000) - F.floor(F.col("before") / 1000)
    gaps = days.withColumn("before", before).where(F.col("before").isNotNull()).withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= idle_minutes * 60_000))
    end = F.least(F.col("before") + F.least(F.col("gap"), F.lit(fill_minutes * 60_000)) * 1000, F.col("midnight"))
    return gaps.select(*keys, "day", F.col("before").alias("start"), end.alias("end"))


def active_seconds(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-1: whole seconds of each interval, summed."""
    return intervals.groupBy(*keys, "day").agg(F.sum(F.floor((F.col("end") - F.col("start")) / 1_000_000)).alias("active_seconds"))


def interval_seconds(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-1 and WIN-2 in one pass: active_seconds, the intervals' whole seconds summed, and union_seconds, the length of their
    union with their ends cut to whole seconds first."""
    length = F.floor((F.col("end") - F.col("start")) / 1_000_000)
    whole = intervals.select(*keys, "day", F.floor(F.col("start") / 1_000_000).alias("s"), F.floor(F.col("end") / 1_000_000).alias("e"), length.alias("length"))
    by = W.partitionBy(*keys, "day").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("s") > F.coalesce(F.col("reach"), F.lit(-1)), 1).otherwise(0)
    islands = whole.withColumn("reach", reach).withColumn("island", F.sum(fresh).over(by))
    spans = islands.groupBy(*keys, "day", "island").agg((F.max("e") - F.min("s")).alias("n"), F.sum("length").alias("length"))
    return spans.groupBy(*keys, "day").agg(F.sum("length").alias("active_seconds"), F.sum("n").alias("union_seconds"))


def union_seconds(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-2: length of the union of the intervals."""
    return interval_seconds(intervals, keys).drop("active_seconds")


def state_seconds(events: DataFrame, keys: Sequence[str], state: str, at: str = "signal_time", status: str = "status", tie: str = "id") -> DataFrame:
    """WIN-3: seconds from the first ``state`` of a run to the first other status; an open run lasts to the end of the day."""
    days = events.select(*keys, F.to_date(at).alias("day"), F.col(at).alias("t"), (F.col(status) == state).alias("on"), tie)
    by = W.partitionBy(*keys, "day").orderBy("t", tie)
    edges = days.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on <> was")
    until = F.coalesce(F.lead("t").over(by), F.date_add("day", 1).cast("timestamp_ntz"))
    runs = edges.withColumn("until", until).where("on")
    seconds = F.floor((micros(F.col("until")) - micros(F.col("t"))) / 1_000_000)
    return runs.groupBy(*keys, "day").agg(F.sum(seconds).alias(f"{state}_seconds"))


def first_response(messages: DataFrame, keys: Sequence[str], at: str = "signal_time", order: str = "id") -> DataFrame:
    """WIN-4: milliseconds from the first user message to the first assistant message after it; -1 if none, 0 if negative."""
    role = F.lower(F.trim("role"))
    days = messages.select(*keys, F.to_date(at).alias("day"), F.col(at).alias("t"), F.col(order).alias("seq"), role.alias("r"))
    first_user = F.min(F.when(F.col("r") == "user", F.struct("seq", "t"))).over(W.partitionBy(*keys, "day"))
    found = days.withColumn("u", first_user)
    answer = F.min(F.when((F.col("r") == "assistant") & (F.col("seq") > F.col("u.seq")), F.struct("seq", "t"))).alias("a")
    found = found.groupBy(*keys, "day").agg(answer, F.first("u").alias("u"))
    took = F.floor((micros(F.col("a.t")) - micros(F.col("u.t"))) / 1000)
    return found.select(*keys, "day", F.when(F.col("a").isNull() | F.col("u").isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), took)).cast("long").alias("first_response_ms"))


def retries(messages: DataFrame, keys: Sequence[str], at: str = "signal_time", order: str = "id") -> DataFrame:
    """WIN-5: user messages that follow a user message, with only other roles between."""
    said = messages.withColumn("_r", F.lower(F.trim("role"))).where(F.col("_r").isin("user", "assistant")).withColumn("day", F.to_date(at))
    again = (F.col("_r") == "user") & (F.lag("_r").over(W.partitionBy(*keys, "day").orderBy(order)) == "user")
    return said.withColumn("_again", again).groupBy(*keys, "day").agg(F.sum(F.coalesce(F.col("_again").cast("int"), F.lit(0))).alias("retries"))


def top_values(totals: DataFrame, keys: Sequence[str], value: str, amount: str, n: int = 3) -> DataFrame:
    """WIN-7: per key the n values with the greatest positive amounts, as (rank) rows."""
    by = W.partitionBy(*keys).orderBy(F.desc(amount), value)
    return totals.where((F.col(amount) > 0) & (F.trim(value) != "")).withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def work_spans(pings: DataFrame, key: str, at: str, active: str, gap_seconds: int = 180, credit_seconds: int = 120) -> DataFrame:
    """WIN-11: spans of pings less than ``gap_seconds`` apart; each ping credits its gap up to ``credit_seconds``."""
    t = F.floor(micros(F.col(at)) / 1_000_000)
    by = W.partitionBy(key).orderBy("t", "id")
    rows = pings.select(key, "id", t.alias("t"), F.col(active).alias("busy")).withColumn("gap", F.col("t") - F.lag("t").over(by))
    rows = rows.withColumn("span", F.sum(F.when(F.col("gap") > gap_seconds, 1).otherwise(0)).over(by))
    credit = F.when((F.col("gap") > 0) & (F.col("gap") <= gap_seconds), F.least(F.col("gap"), F.lit(credit_seconds))).otherwise(0)
    return rows.withColumn("credit", credit).groupBy(key, "span").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.sum("credit").alias("duration_seconds"), F.sum(F.when(F.col("busy"), F.col("credit")).otherwise(0)).alias("active_seconds"))


def deltas(counters: DataFrame, keys: Sequence[str], total: str, *order: str) -> DataFrame:
    """WIN-13: what a cumulative counter grew by; the first value counts whole, a fall counts as nothing."""
    before = F.lag(total, 1, 0).over(W.partitionBy(*keys).orderBy(*order))
    return counters.withColumn("delta", F.greatest(F.col(total) - before, F.lit(0)))


def interpolated(rows: DataFrame, keys: Sequence[str], order: str, start: str, end: str) -> DataFrame:
    """WIN-14: times spread evenly from start to end over the rows of a key; a single row gets the start."""
    by = W.partitionBy(*keys)
    place, n = F.row_number().over(by.orderBy(order)) - 1, F.count(F.lit(1)).over(by)
    share = (micros(F.col(end)) - micros(F.col(start))) * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))
    return rows.withColumns({"_i": place, "_n": n}).withColumn("at_us", F.floor(micros(F.col(start)) + share).cast("long")).drop("_i", "_n")


def spliced(parents: DataFrame, children: DataFrame, key: str, seq: str, anchor: str) -> DataFrame:
    """WIN-16: children's rows put after the parent row that started them, and all numbered anew."""
    both = parents.withColumns({"_a": F.col(seq), "_b": F.lit(0)}).unionByName(children.withColumns({"_a": F.col(anchor), "_b": F.lit(1)}), allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_a", "_b", seq)).cast("long")).drop("_a", "_b")


LAST = (1 << 31) - 1


def spliced_forest(messages: DataFrame, links: DataFrame, order: Sequence[str], agent: Column, session: str = "session_id") -> DataFrame:
    """WIN-16, JN-25: messages of sub-agents behind the call that started them, at any depth: root and place of every message.

    ``links``: child, parent and rank, the child's place among its siblings. The n-th child of a session comes behind the session's
    n-th ``agent`` row, one without such a row behind all rows of its parent. A session on a cycle of links, or below one, is a root
    itself. A row's path is where its session's ancestors were called, which orders all rows of a tree. Rows are dealt out by ranges of
    this order, and numbered in each range behind those of their tree in the ranges before, so a tree of any size is many tasks.
    """
    placed = messages.withColumn("_p", F.row_number().over(W.partitionBy(session).orderBy(*order)))
    calls = placed.where(agent).select(F.col(session).alias("parent"), F.col("_p").alias("at"), F.row_number().over(W.partitionBy(session).orderBy("_p")).alias("rank"))
    tops = roots(links).where("root <> child").select("child", "root")
    kids = links.join(tops.select("child"), "child").withColumn("rank", F.row_number().over(W.partitionBy("parent").orderBy("rank", "child")))
    step = F.struct(F.coalesce("at", F.lit(LAST)).alias("at"), F.lit(1).alias("below"), F.col("rank").alias("rank"))
    known = stage(kids.join(calls, ["parent", "rank"], "left").select("child", "parent", step.alias("step")), "calls")
    level = known.join(known.select(F.col("child").alias("parent")), "parent", "left_anti").select("child", F.array("step").alias("path"))
    paths = level = stage(level, "paths")
    while not level.isEmpty():
        above = level.select(F.col("child").alias("parent"), "path")
        level = stage(known.join(above, "parent").select("child", F.concat("path", F.array("step")).alias("path")), "paths")
        paths = paths.unionByName(level)
    own = F.array(F.struct(F.col("_p").alias("at"), F.lit(0).alias("below"), F.lit(0).alias("rank")))
    none = F.array().cast("array<struct<at: int, below: int, rank: int>>")
    rows = placed.join(paths.withColumnRenamed("child", session), session, "left").join(tops.withColumnRenamed("child", session), session, "left")
    rows = rows.withColumns({"root": F.coalesce("root", session), "_path": F.concat(F.coalesce("path", none), own)})
    dealt = stage(rows.drop("_p", "path").repartitionByRange("root", "_path", session).withColumn("_part", F.spark_partition_id()), "forest")
    sizes = dealt.groupBy("root", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("root").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", before).where("_before > 0").select(F.col("root").alias("_root"), F.col("_part").alias("_of"), "_before")
    place = F.row_number().over(W.partitionBy("root", "_part").orderBy("_path", session)) + F.coalesce("_before", F.lit(0))
    same = F.col("root").eqNullSafe(F.col("_root")) & (F.col("_part") == F.col("_of"))
    return dealt.join(sizes, same, "left").withColumn("place", place.cast("long")).select(*messages.columns, "root", "place")


def tree_totals(sessions: DataFrame, links: DataFrame, sums: Sequence[str], first: str, last: str, session: str = "id") -> DataFrame:
    """JN-25: one row for each root: what its tree adds up to, from its first to its last moment, and how many sessions it has."""
    tops = roots(links).where("root <> child").withColumnRenamed("child", session)
    rows = sessions.join(tops, session, "left").withColumn("root", F.coalesce("root", session))
    return rows.groupBy("root").agg(*[F.sum(c).alias(c) for c in sums], F.min(first).alias(first), F.max(last).alias(last), F.count(F.lit(1)).alias("sessions"))


def skill_uses(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """WIN-8: a skill file that was read is used by the next execution in the same user turn.

    Columns: key, seq, role, reads (skill tokens that the message reads), executes (boolean). A user
    message opens a turn and forgets what was pending; reads queue up, once each; an execution takes the
    last one and empties the queue. The turn's state runs through the rows, so each session is folded in
    order, batch by batch, without holding a session whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, turn, pending = None, None, []
        for batch in batches:
            out = []
            for who, seq, role, reads, executes in zip(batch[key], batch["seq"], batch["role"], batch["reads"], batch["executes"]):
                if who != current:
                    current, turn, pending = who, None, []
                if role == "user":
                    turn, pending = seq, []
                    continue
                for token in reads if reads is not None else []:
                    if token.lower() not in [p.lower() for p in pending]:
                        pending.append(token)
                if executes and pending and turn is not None:
                    out.append((who, turn, pending[-1]))
                    pending = []
            yield pd.DataFrame(out, columns=[key, "turn_seq", "token"])

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    ordered = messages.select(key, "seq", F.lower(F.trim("role")).alias("role"), "reads", "executes").repartition(key).sortWithinPartitions(key, "seq")
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, turn_seq {kinds['seq']}, token string")
