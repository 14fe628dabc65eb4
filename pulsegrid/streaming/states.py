"""Stateful operators on streams: snapshots to deltas, suppression and throttling (STR).

Each has a batch form with the same result over the same rows, which the tests compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from pulsegrid.functions import text

EVENT = "session string, event_time timestamp_ntz, event_type string, status string, tokens_delta bigint, messages_delta bigint"
SNAPSHOT = "session, captured_at, seq, status, tokens, messages"
DELTA_CAP = 500_000_000


def snapshot_events(snapshots: DataFrame, idle_days: int = 45, late: str = "48 hours") -> DataFrame:
    """STR-1: events from a stream of cumulative snapshots (columns of SNAPSHOT), one state per session.

    A new session opens and brings its totals; later snapshots bring status changes and what the totals
    grew by. A total that falls counts as nothing and is the base of the next difference. A session's
    state is dropped ``idle_days`` after its last snapshot, in event time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        status, tokens, messages = state.get if known else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["captured_at", "seq"])
        out = []
        for at, s, t, m in zip(rows["captured_at"], rows["status"], rows["tokens"], rows["messages"]):
            if not known:
                out.append((key[0], at, "SESSION_OPEN", s, 0, 0))
            elif s != status:
                out.append((key[0], at, "STATUS_CHANGE", s, 0, 0))
            dt, dm = t - tokens, m - messages
            if 0 < dt <= DELTA_CAP:
                out.append((key[0], at, "TOKEN_DELTA", s, dt, 0))
            if dm > 0:
                out.append((key[0], at, "MESSAGE_DELTA", s, 0, dm))
            known, status, tokens, messages = True, s, t, m
        state.update((status, int(tokens), int(messages)))
        forget = int(rows["_at"].max().timestamp() * 1000) + idle_days * 86_400_000
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "event_time", "event_type", "status", "tokens_delta", "messages_delta"])

    timed = snapshots.withColumn("_at", F.col("captured_at").cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy("session").applyInPandasWithState(run, EVENT, "status string, tokens bigint, messages bigint", "append", GroupStateTimeout.EventTimeTimeout)


def snapshot_events_batch(snapshots: DataFrame) -> DataFrame:
    """The same over a whole table, with windows."""
    by = W.partitionBy("session").orderBy("captured_at", "seq")
    old = {f"_{c}": F.lag(c).over(by) for c in ("status", "tokens", "messages")}
    rows = snapshots.withColumns(old).withColumn("_new", F.col("_status").isNull())
    dt, dm = F.col("tokens") - F.coalesce("_tokens", F.lit(0)), F.col("messages") - F.coalesce("_messages", F.lit(0))
    none = F.lit(0).cast("long")

    def made(test: Column, kind: str, t: Column = none, m: Column = none) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("event_type"), t.cast("long").alias("tokens_delta"), m.cast("long").alias("messages_delta")))

    events = F.array(made(F.col("_new"), "SESSION_OPEN"), made(~F.col("_new") & (F.col("status") != F.col("_status")), "STATUS_CHANGE"), made((dt > 0) & (dt <= DELTA_CAP), "TOKEN_DELTA", t=dt), made(dm > 0, "MESSAGE_DELTA", m=dm))
    rows = rows.withColumn("_e", F.explode(F.array_compact(events)))
    return rows.select("session", F.col("captured_at").alias("event_time"), "_e.event_type", "status", "_e.tokens_delta", "_e.messages_delta")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """STR-4, STR-17: the first row of each key; keys are forgotten ``late`` after their time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def work_sessions(stream: DataFrame, key: str, at: str, gap: str = "180 seconds", late: str = "48 hours") -> DataFrame:
    """STR-13: spans of pings at most ``gap`` apart; times count in whole seconds."""
    whole = stream.withColumn("_at", F.date_trunc("second", at))
    if stream.isStreaming:
        whole = whole.withWatermark("_at", late)
    spans = whole.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("pings"), F.max("_at").alias("last_ping"))
    return spans.select(key, F.col("w.start").alias("started"), "last_ping", "pings")


def throttled(alerts: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """STR-18, STR-20: an alert passes if its key's last passed one is ``seconds`` old; it says how many were held back.

    Whether an alert passes depends on which passed before, so each key is folded in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, held = None, None, 0
        for batch in batches:
            out = []
            for who, when, n in zip(batch[key], batch[at], batch["id"]):
                if who != current:
                    current, last, held = who, None, 0
                if last is None or (when - last).total_seconds() >= seconds:
                    out.append((who, when, n, held))
                    last, held = when, 0
                else:
                    held += 1
            yield pd.DataFrame(out, columns=[key, at, "id", "suppressed"])

    ordered = alerts.select(key, at, "id").repartition(key).sortWithinPartitions(key, at, "id")
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, id {kinds['id']}, suppressed bigint")


#: What a tool's name says about the activity.
TOOL_STATES = {"Read": "reading", "Write": "writing", "Edit": "writing", "NotebookEdit": "writing", "Bash": "running", "Shell": "running", "Glob": "searching", "Grep": "searching", "WebFetch": "browsing", "WebSearch": "browsing", "Agent": "spawning"}


def tool_state(tool: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TOOL_STATES.items() for x in pair])
    return F.coalesce(F.get(F.array(known), F.lit(0))[tool], F.when(F.coalesce(tool, F.lit("")) != "", "running").otherwise("idle"))


def activity_state(bubble: Column, tool: Column, since: Column, tool_age: Column, summary_age: Column, interval: float = 0, spawning: int = 1200) -> Column:
    """STR-12: one of ten states from the raw status and tool, and the seconds since the last activity, tool call and summary.

    Clients report every ``interval`` seconds; activity counts for two and a half of them, half a minute at least, and who
    waits does so for two minutes at least.
    """
    timeout = max(30.0, 2.5 * interval)
    waiting, doing = max(120.0, timeout), tool_state(text.normal_tool(tool))
    thinking = bubble.isin("thinking", "processing_tool_result")
    return (
        F.when(summary_age < timeout, "compacting")
        .when(tool_age < timeout, doing)
        .when(bubble == "waiting_for_user", F.when(since < waiting, "waiting").otherwise("idle"))
        .when((bubble == "executing_tool") & (doing == "spawning") & (since < spawning), "spawning")
        .when(thinking & (since <= timeout), "thinking")
        .when(since.isNull() | (since > timeout), "idle")
        .when(bubble == "executing_tool", doing)
        .otherwise("idle")
    )


def reconciled_count(stored: Column, reported: Column, gap: int = 200) -> Column:
    """STR-8: how many messages a session shows: those stored, unless the client reports so many more that they are yet to come."""
    known = (F.coalesce(stored, F.lit(0)) > 0) & (reported > 0)
    return F.when(known & (reported - stored <= gap), stored).otherwise(reported)


def reported_snapshot(stored: Column, incoming: Column, at_tail: Column) -> Column:
    """STR-8, at ingest: a client that has sent all it has, and whose messages are stored, is not believed to have more."""
    return F.when(incoming <= 0, F.greatest(incoming, stored)).when(at_tail & (stored > 0), stored).otherwise(incoming)


def missing_baseline(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """STR-19: OPEN, TOKEN and MESSAGE events that sessions should have and don't."""
    wanted = F.array_compact(F.array(F.struct(F.lit("SESSION_OPEN").alias("event_type"), F.lit(0).cast("long").alias("amount")), F.when(F.expr("input_tokens + output_tokens > 0"), F.struct(F.lit("TOKEN_DELTA").alias("event_type"), F.expr("input_tokens + output_tokens").alias("amount"))), F.when(F.col("total_messages") > 0, F.struct(F.lit("MESSAGE_DELTA").alias("event_type"), F.col("total_messages").cast("long").alias("amount")))))
    rows = sessions.select(F.col("id").alias("session_id"), F.inline(wanted))
    return rows.join(events.select("session_id", "event_type"), ["session_id", "event_type"], "left_anti")


def cursors(rows: DataFrame, key: str, row_id: str, at: str, now: str, keep_days: int = 45) -> DataFrame:
    """STR-14: the last id and time of each key; rows older than ``keep_days`` don't count."""
    fresh = rows.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(keep_days)))
    return fresh.groupBy(key).agg(F.max(row_id).alias("last_id"), F.max(at).alias("last_time"))


def batched(rows: DataFrame, key: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """STR-15: ``rows`` with the number of their key's batch, a new one after ``most_rows`` rows or ``most_bytes`` bytes."""
    by = W.partitionBy(key).orderBy(order)
    before = F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    return rows.withColumn("batch", F.greatest(F.floor((F.row_number().over(by) - 1) / most_rows), F.floor(before / most_bytes)))


def debounced(marks: DataFrame, key: str, at: str, quiet: int = 15, most: int = 60) -> DataFrame:
    """STR-10: when each key's work is due: ``quiet`` seconds after its last mark, ``most`` seconds after its first one at the latest.

    (key, due, marks). A mark that comes when the work is already done begins anew, so each key is folded in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in marks.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, first, last, n = None, None, None, 0

        def due() -> pd.Timestamp:
            return min(last + pd.Timedelta(seconds=quiet), first + pd.Timedelta(seconds=most))

        for batch in batches:
            out = []
            for k, when in zip(batch[key], batch[at]):
                if n and (k != who or when >= due()):
                    out.append((who, due(), n))
                    n = 0
                who, first, last, n = k, when if n == 0 else first, when, n + 1
            yield pd.DataFrame(out, columns=[key, "due", "marks"])
        if n:
            yield pd.DataFrame([(who, due(), n)], columns=[key, "due", "marks"])

    ordered = marks.select(key, at).repartition(key).sortWithinPartitions(key, at)
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, due {kinds[at]}, marks bigint")


def first_claims(requests: DataFrame, keys: list[str], at: str, row_id: str, sent: str, skew_seconds: int = 300, keep_seconds: int = 600) -> DataFrame:
    """STR-17: requests that are no replays: sent within ``skew_seconds`` of their arrival, with a nonce that is not known.

    A nonce is forgotten ``keep_seconds`` after it was claimed, which is after the skew that lets its request in. A refused
    request claims nothing, so in a run of requests with one nonce those count that come ``keep_seconds`` after the last that counted.
    """
    fresh = requests.where(F.abs(F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col(sent).cast("timestamp"))) <= skew_seconds)
    named = fresh.withColumn("_key", F.concat_ws("\0", *keys)).select(F.col("_key"), F.col(at).alias("_at"), F.col(row_id).alias("id"))
    claimed = throttled(named, "_key", "_at", keep_seconds).select(F.col("id").alias(row_id))
    return requests.join(claimed, row_id, "left_semi")


def audit_state(state: Column, lease_until: Column, grown: Column, now: Column) -> Column:
    """MAT-9: RUNNING keeps its lease while it lasts and waits again after; DONE waits again once the session has grown."""
    return F.when((state == "RUNNING") & (lease_until.isNull() | (lease_until <= now)), "PENDING").when((state == "DONE") & grown, "PENDING").otherwise(state)
