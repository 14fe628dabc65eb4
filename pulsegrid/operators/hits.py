"""JSON arrays of slash and skill hits, and tool calls of MCP servers (AGG-M10, M11, C7, C8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text

HITS = "array<struct<token:string,kind:string>>"


def exploded(messages: DataFrame, column: str = "slash_hits_json") -> DataFrame:
    """A row for each hit with a token; bad JSON and null arrays have none. Noise is kept."""
    cheap = messages.where(F.col(column).contains("{"))  # rows without an object are not parsed
    return cheap.withColumn("_hit", F.explode(F.from_json(column, HITS))).withColumns({"token": F.trim("_hit.token"), "kind": F.lower(F.trim("_hit.kind"))}).drop("_hit").where("token <> ''")


def ranking(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-M10: how often each token was used, by how many users and sessions; noise left out."""
    hits = exploded(messages).where("kind <> 'noise'")
    return hits.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("user_code").alias("users"), F.count_distinct("session_id").alias("sessions"))


def first_seen(messages: DataFrame) -> DataFrame:
    """AGG-M11: the distinct (token, kind) of a session in the order of first use."""
    hits = exploded(messages).groupBy("session_id", "token", "kind").agg(F.min("id").alias("first_id"))
    listed = F.array_sort(F.collect_list(F.struct("first_id", "token", "kind")))
    return hits.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda h: F.concat_ws("|", h["token"], h["kind"])), ",").alias("tokens"))


PARTS = "array<struct<type:string,tool_name:string>>"


def carries_out(parts_json: Column) -> Column:
    """Whether a message's parts hold a call of a tool that carries out a skill."""
    parts = F.from_json(parts_json, PARTS)
    return F.coalesce(F.exists(parts, lambda p: F.coalesce(p["type"] == "tool_call", F.lit(False)) & text.executes(p["tool_name"])), F.lit(False))


def part_calls(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """AGG-C8: MCP calls that only the parts of messages tell of: work_date, user_code, session_id, tool_name.

    They count for sessions without any MCP event on that day; parts that are no JSON have none.
    """
    day = F.to_date("event_time").alias("work_date")
    told = calls.where(text.mcp_server(F.col("tool_name")).isNotNull()).select("session_id", day).distinct()
    cheap = messages.where(F.lower("content_parts_json").contains("mcp__"))
    named = cheap.select(F.to_date("message_time").alias("work_date"), "user_code", "session_id", F.explode(F.from_json("content_parts_json", PARTS)).alias("_part"))
    named = named.where("_part.type = 'tool_call'").select("work_date", "user_code", "session_id", F.col("_part.tool_name").alias("tool_name"))
    return named.where(text.mcp_server(F.col("tool_name")).isNotNull()).join(told, ["session_id", "work_date"], "left_anti").select("work_date", "user_code", "session_id", "tool_name")


def capability_daily(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """AGG-C7, MAT-2: per day and user, roll-up rows (sub_item '') and detail rows of skills, plugins and MCP servers.

    ``calls``: user_code, session_id, tool_name, event_time. A skill counts as itself; ``ns:skill`` also
    counts for the plugin ns, as roll-up and as detail. ``mcp__server__tool`` counts for server and tool; what
    message parts tell of calls counts where no event does. All rows that a hit or a call counts for are made where it is.
    """

    def entries(*rows: tuple) -> Column:
        return F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, ("kind", "item", "sub_item"))]) for row in rows]))

    item, none = text.skill_item(F.col("token")), F.lit("")
    used = exploded(messages).where(F.col("kind").isin("skill", "nl_skill")).select(F.to_date("message_time").alias("work_date"), "user_code", "session_id", "kind", item.alias("skill")).where("skill is not null")
    space, plugin = text.namespace(F.col("skill")), F.lit("plugin")
    used = used.select("work_date", "user_code", "session_id", entries((F.col("kind"), F.col("skill"), none), (plugin, space, none), (plugin, space, F.get(F.split("skill", ":"), 1))))
    mcp, server = F.lit("mcp"), text.mcp_server(F.col("tool_name"))
    events = calls.where(F.lower("tool_name").startswith("mcp__")).select(F.to_date("event_time").alias("work_date"), "user_code", "session_id", "tool_name")
    called = events.unionByName(part_calls(messages, calls)).select("work_date", "user_code", "session_id", entries((mcp, server, none), (mcp, server, text.mcp_tool(F.col("tool_name")))))
    rows = used.unionByName(called).where("item is not null")
    return rows.groupBy("work_date", "user_code", "kind", "item", "sub_item").agg(F.count(F.lit(1)).alias("invoke_count"), F.count_distinct("session_id").alias("session_count"))


def capability_ranking(daily: DataFrame, kinds: Sequence[str], limit: int = 20) -> DataFrame:
    """FN-G8: items of the kinds by use: uses, users across kinds, sessions, explicit and natural-language uses, and their details as a list.

    The most used come first, ties by name; ``children`` are (sub_item, uses, sessions), most used first.
    """
    own = daily.where(F.col("kind").isin(*kinds))
    detail = F.col("sub_item") != ""
    parts = own.groupBy("item", "sub_item").agg(F.sum("invoke_count").alias("uses"), F.sum("session_count").alias("sessions"), F.sum(F.when(F.col("kind") == "nl_skill", F.col("invoke_count")).otherwise(0)).alias("natural"))
    users = own.where(~detail).groupBy("item").agg(F.count_distinct("user_code").alias("users"))
    child = F.struct((-F.col("uses")).alias("order"), F.col("sub_item"), F.col("uses"), F.col("sessions"))
    whole = parts.groupBy("item").agg(
        *[F.sum(F.when(~detail, F.col(c))).alias(c) for c in ("uses", "sessions", "natural")],
        F.array_sort(F.collect_list(F.when(detail, child))).alias("children"),
    )
    top = whole.join(users, "item").orderBy(F.desc("uses"), "item").limit(limit)
    listed = F.transform("children", lambda c: F.concat_ws("|", c["sub_item"], c["uses"], c["sessions"]))
    return top.select("item", "uses", "users", "sessions", (F.col("uses") - F.col("natural")).alias("explicit"), "natural", F.array_join(listed, ",").alias("children"))
