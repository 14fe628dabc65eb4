"""What coding tools keep in SQLite, as sessions and messages: the tools' own joins over ``sqlite_table`` and ``sqlite_kv`` (SRC-1, 4, 7, 9, 10).

Register the sources first with ``register``. Filters on keys and row ids reach SQLite; the joins are Spark's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .keyvalue import KeyValueStore, SqliteTable

BUBBLE = "bubbleId:"  # fixed value: how keys of single messages begin; 36 characters of a session's id follow


def register(spark: SparkSession) -> None:
    for source in (KeyValueStore, SqliteTable):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def table(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.format("sqlite_table").schema(columns).option("pushdown", "true").option("path", path).option("table", name).load()


def millis(column: Column) -> Column:
    """Epoch milliseconds; zero, negative and null ones are no time."""
    return F.when(column > 0, F.timestamp_millis(column).cast("timestamp_ntz"))


def bubble_sessions(spark: SparkSession, path: str, since: str, name: str = "cursorDiskKV") -> DataFrame:
    """SRC-1: sessions with a message after ``since`` (ISO, as the store writes it): session_id, last_at."""
    rows = spark.read.format("sqlite_kv").option("pushdown", "true").option("path", path).option("table", name).load()
    own = rows.where((F.col("key") >= BUBBLE) & (F.col("key") < BUBBLE[:-1] + ";"))
    timed = own.select(F.substring("key", len(BUBBLE) + 1, 36).alias("session_id"), F.get_json_object("value", "$.createdAt").alias("at")).where(F.col("at") > since)
    return timed.groupBy("session_id").agg(F.max("at").alias("last_at"))


def bubbles_after(spark: SparkSession, path: str, row_id: int, name: str = "cursorDiskKV") -> DataFrame:
    """SRC-1: messages that were written after a row id: row_id, session_id, created_at."""
    rows = spark.read.format("sqlite_kv").option("pushdown", "true").option("path", path).option("table", name).load()
    fresh = rows.where((F.col("row_id") > row_id) & F.col("key").startswith(BUBBLE))
    return fresh.select("row_id", F.substring("key", len(BUBBLE) + 1, 36).alias("session_id"), F.get_json_object("value", "$.createdAt").alias("created_at"))


def counted_sessions(spark: SparkSession, path: str, since: float) -> DataFrame:
    """SRC-4: sessions by their last message, or end, or start, since an epoch second, with counts by role."""
    kept = "source string, model string, title string, input_tokens bigint, output_tokens bigint, tool_call_count bigint"
    sessions = table(spark, path, "sessions", f"id string, {kept}, started_at double, ended_at double")
    messages = table(spark, path, "messages", "session_id string, role string, timestamp double")
    said = messages.groupBy("session_id").agg(F.max("timestamp").alias("last_message"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))
    both = sessions.join(said, sessions["id"] == said["session_id"], "left").where(F.coalesce("last_message", "ended_at", "started_at") >= since)
    second = lambda c: F.when(c > 0, F.timestamp_micros(F.floor(c * 1_000_000)).cast("timestamp_ntz"))
    active = F.coalesce("last_message", F.when(F.col("ended_at") > 0, F.col("ended_at")), "started_at")
    return both.select(F.col("id").alias("session_id"), *[c.split()[0] for c in kept.split(", ")], second(F.col("started_at")).alias("started_at"), second(active).alias("last_activity"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("user_messages", "assistant_messages")])


def last_messages(spark: SparkSession, path: str, most: int) -> DataFrame:
    """SRC-4: the last ``most`` messages of each session, oldest first by ``place``."""
    rows = table(spark, path, "messages", "id string, session_id string, role string, content string, tool_name string, timestamp double")
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id")))
    kept = rows.withColumn("_back", back).where(F.col("_back") <= most)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("_back"))).cast("long")).drop("_back")


def live_sessions(spark: SparkSession, path: str, since_ms: int) -> DataFrame:
    """SRC-7, 9: sessions that are not archived and were changed since an epoch millisecond, with their turns."""
    none = F.lit(0)
    rows = table(spark, path, "session", "id string, directory string, title string, model string, tokens_input bigint, tokens_output bigint, time_created bigint, time_updated bigint, time_archived bigint")
    rows = rows.where((F.coalesce("time_archived", none) == 0) & (F.coalesce("time_updated", "time_created") >= since_ms))
    turns = parsed_messages(spark, path).groupBy("session_id").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in ("user", "assistant")], F.max_by("model", F.when(F.col("model") != "", -F.col("created"))).alias("_model"))
    both = rows.join(turns, rows["id"] == turns["session_id"], "left")
    started, model = millis(F.coalesce("time_created", none)), F.when(F.coalesce("model", F.lit("")) != "", F.col("model"))
    return both.select(F.col("id").alias("session_id"), F.coalesce("directory", F.lit("")).alias("directory"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(model, "_model").alias("model"), *[F.coalesce(c, none).alias(c) for c in ("tokens_input", "tokens_output")], started.alias("started_at"), F.coalesce(millis(F.coalesce("time_updated", none)), started).alias("last_activity"), *[F.coalesce(f"{r}_messages", none).alias(f"{r}_messages") for r in ("user", "assistant")])


def parsed_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages with what their JSON says: role, model, times, and tokens as they count (cache and reasoning included)."""
    shape = "role string, modelID string, time struct<created: bigint, completed: bigint>, tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>"
    rows = table(spark, path, "message", "id string, session_id string, time_created bigint, data string").withColumn("d", F.from_json("data", shape))
    added = lambda *names: sum((F.coalesce(F.col(f"d.tokens.{n}"), F.lit(0)) for n in names), F.lit(0)).cast("long")
    created = F.coalesce(F.when(F.col("time_created") > 0, F.col("time_created")), F.col("d.time.created"))
    return rows.select("id", "session_id", F.col("d.role").alias("role"), F.coalesce("d.modelID", F.lit("")).alias("model"), created.alias("created"), F.coalesce(F.when(F.col("d.time.completed") > 0, F.col("d.time.completed")), created).alias("completed"), added("input", "cache.read", "cache.write").alias("input_tokens"), added("output", "reasoning").alias("output_tokens"))


def messages_with_parts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7, 9: user and assistant messages with their parts in order, as a JSON array; messages without parts are left out."""
    parts = table(spark, path, "part", "id string, message_id string, session_id string, data string")
    listed = parts.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "data"))), lambda p: p["data"]), ",").alias("_parts"))
    rows = parsed_messages(spark, path).where(F.col("role").isin("user", "assistant"))
    both = rows.join(listed, rows["id"] == listed["message_id"])
    return both.select("id", "session_id", "role", "model", millis(F.col("created")).alias("at"), "input_tokens", "output_tokens", F.concat(F.lit("["), "_parts", F.lit("]")).alias("parts"))


# ---- SRC-10: summaries in protobuf's wire format, without a descriptor

Wire = tuple[int, int | bytes]  # number of a field, and its value


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and end of the varint at ``at``; ValueError if it does not end within ten bytes or the data."""
    value = 0
    for i, byte in enumerate(data[at : at + 10]):
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            return value & (1 << 64) - 1, at + i + 1
    raise ValueError("varint without an end")


def wire(data: bytes) -> Iterator[Wire]:
    """Fields of a message in order; what comes after the first one that can not be read is left out."""
    at = 0
    try:
        while at < len(data):
            tag, at = varint(data, at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(data, at)
            elif kind in (1, 2, 5):
                size, at = varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
                if size > len(data) - at:
                    return
                value, at = data[at : at + size], at + size
            else:
                return
            yield tag >> 3, value
    except ValueError:
        return


def last(data: bytes, number: int) -> int | bytes | None:
    """The value of a field; the last one counts."""
    return next((v for n, v in reversed(list(wire(data))) if n == number), None)


def text(value: int | bytes | None) -> str:
    return value.decode(errors="replace") if isinstance(value, bytes) else ""


def moment(value: int | bytes | None) -> int | None:
    """Microseconds of a timestamp message, none before 1970."""
    if not isinstance(value, bytes):
        return None
    seconds, nanos = (x if isinstance(x, int) else 0 for x in (last(value, 1), last(value, 2)))
    return seconds * 1_000_000 + nanos // 1_000 if 0 < seconds < 1 << 40 else None


def decoded(value: bytes) -> bytes:
    """Base64 if it is that, else the bytes themselves."""
    try:
        return base64.b64decode(value.strip(), validate=True) or value
    except ValueError:
        return value


def folder(uri: str) -> str:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri


SUMMARY = "session_id string, title string, cwd string, created_us bigint, updated_us bigint"


def summaries(blob: bytes) -> Iterator[tuple]:
    """Rows of ``SUMMARY`` from an index of conversations: entries of id and a wrapped, base64 message."""
    for number, entry in wire(decoded(blob)):
        if number != 1 or not isinstance(entry, bytes):
            continue
        name, wrapper = text(last(entry, 1)), last(entry, 2)
        packed = next((v for n, v in wire(wrapper) if n == 1), None) if isinstance(wrapper, bytes) else None
        try:
            body = base64.b64decode(packed or b"", validate=True)
        except (ValueError, TypeError):
            continue
        if not name or not isinstance(packed, bytes):
            continue
        places = last(body, 9)
        place = next((text(v) for n, v in wire(places) if n == 1), "") if isinstance(places, bytes) else ""
        updated = moment(last(body, 3))
        for n, v in wire(body):
            if n in (3, 10) and moment(v) is not None:
                updated = moment(v)
        yield text(last(body, 4)) or name, text(last(body, 1)), folder(place), moment(last(body, 7)), updated


def conversation_summaries(blobs: DataFrame, column: str) -> DataFrame:
    """SRC-10: session_id, title, cwd, created_at, updated_at of every conversation in index blobs (binary, or text of base64)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        for batch in batches:
            yield pd.DataFrame([row for blob in batch["blob"] if blob is not None for row in summaries(bytes(blob))], columns=names, dtype=object)

    found = blobs.select(F.col(column).cast("binary").alias("blob")).mapInPandas(run, SUMMARY)
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return found.select("session_id", "title", "cwd", at("created_us").alias("created_at"), at("updated_us").alias("updated_at"))
