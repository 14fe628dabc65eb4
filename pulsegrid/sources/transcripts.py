"""Transcripts of coding tools as sessions and messages (SRC-2, 3, 5, 6, 8, 11).

Files are read by Spark as text or whole JSON; one bad line costs that line only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: One line of a message transcript.
ENTRY = """type string, subtype string, uuid string, sessionId string, cwd string, gitBranch string, timestamp string, isSidechain boolean,
    message struct<role string, model string, content string, usage struct<input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint>>"""
#: A part of a message's content.
PART = "array<struct<type string, text string, name string, id string>>"
#: One line of a log with cumulative counters.
ENVELOPE = "timestamp string, type string, payload struct<type string, id string, cwd string, model string, info struct<total_token_usage struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint>>>"


def when(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def lines(spark: SparkSession, path: str, changed_after: str | None = None) -> DataFrame:
    """Lines of all files below ``path`` with their file; SRC-18: only files changed after a time."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if changed_after:
        reader = reader.option("modifiedAfter", changed_after)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """The lines that are JSON objects of the schema."""
    return rows.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where("e.type is not null").select("file", "e.*")


def message_rows(entries: DataFrame) -> DataFrame:
    """Messages of user and assistant entries: a tool's result is not a user message."""
    known = entries.where(F.col("type").isin("user", "assistant") & F.col("message").isNotNull())
    parts = F.from_json("message.content", PART)
    tools = F.transform(F.filter(parts, lambda p: p["type"] == "tool_use"), lambda p: p["name"])
    result = F.exists(parts, lambda p: p["type"] == "tool_result")
    text = F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), F.col("message.content"))
    return known.select(
        F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).alias("session_id"),
        F.col("uuid").alias("message_id"),
        when(F.col("timestamp")).alias("message_time"),
        F.when((F.col("type") == "user") & F.coalesce(result, F.lit(False)), "tool").otherwise(F.col("type")).alias("role"),
        F.col("message.model").alias("model"),
        F.coalesce(tools, F.array().cast("array<string>")).alias("tools"),
        text.alias("content_text"),
        F.coalesce("message.usage.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("message.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        "cwd",
        F.col("gitBranch").alias("git_branch"),
    )


def sessions(messages: DataFrame) -> DataFrame:
    """One row per session from its messages."""
    at = F.col("message_time")
    return messages.groupBy("session_id").agg(
        F.min(at).alias("started_at"),
        F.max(at).alias("last_activity"),
        F.max_by("model", F.when(F.col("model").isNotNull(), at)).alias("model"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"),
        F.min_by("git_branch", F.when(F.col("git_branch").isNotNull(), at)).alias("git_branch"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def counter_deltas(entries: DataFrame) -> DataFrame:
    """SRC-3, SRC-8: what each token_count entry adds to its session; falling counters add nothing."""
    counts = entries.where("payload.type = 'token_count' and payload.info.total_token_usage is not null")
    by = W.partitionBy("file").orderBy("at")
    rows = counts.select("file", when(F.col("timestamp")).alias("at"), F.col("payload.info.total_token_usage").alias("u"))
    grown = {n: F.greatest(F.col(f"u.{n}") - F.coalesce(F.lag(F.col(f"u.{n}")).over(by), F.lit(0)), F.lit(0)) for n in ("input_tokens", "output_tokens")}
    return rows.withColumns(grown).where("input_tokens > 0 or output_tokens > 0").select("file", "at", "input_tokens", "output_tokens")


def untimed_turns(documents: DataFrame) -> DataFrame:
    """SRC-6: whole-file sessions (session_id, started_at, ended_at, total_tokens, roles array): times and tokens spread evenly over the turns."""
    n = F.size("roles")
    turns = documents.select("session_id", "started_at", "ended_at", "total_tokens", n.alias("n"), F.posexplode("roles").alias("pos", "role"))
    span = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    at = F.unix_micros(F.col("started_at").cast("timestamp")) + F.floor(span * F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1)))
    return turns.select("session_id", "pos", "role", F.timestamp_micros(at.cast("long")).cast("timestamp_ntz").alias("message_time"), F.floor(F.col("total_tokens") / F.col("n")).alias("tokens"))
