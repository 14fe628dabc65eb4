"""AGG: the grouped metrics, each a rollup of one joined table, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import filters
from pulsegrid.operators.rollups import Rollup, with_session

from .bindings import Lake, with_tables

START, END = "1996-01-01 00:00:00", "1998-01-01 00:00:00"
ACTIVE = ("urgent", "high", "medium")
USER, PROJECT = "u7", "proj7"
SESSIONS = "session_id IS NOT NULL"

SESSION_COLUMNS = "id user_code target_type project_name model repo_url invalid_reason".split()

COUNTED = "event_type IN ('SESSION_OPEN', 'TOKEN_DELTA', 'MESSAGE_DELTA')"
TOOL = "event_type = 'TOOL_CALL'"
TOKENS, MESSAGES = "coalesce(sum(tokens_delta), 0)", "coalesce(sum(messages_delta), 0)"
SESSION_N, USER_N, PROJECT_N = "count(DISTINCT session_id)", "count(DISTINCT user_code)", "count(DISTINCT s_project_name)"
BOTH = {"input_tokens": "coalesce(sum(input_tokens_delta), 0)", "output_tokens": "coalesce(sum(output_tokens_delta), 0)"}
DAY = {"day": "cast(event_time AS date)"}
ROLE = "lower(trim(role))"


@dataclass(frozen=True)
class Query:
    """A rollup over ``table`` (es, ms: events, messages with their session), and its filters."""

    table: str
    rollup: Rollup
    time: str | None = None  # the column that the window is on
    closed: bool = False
    valid: bool = True

    def frame(self, lake: Lake) -> DataFrame:
        if self.table in ("es", "ms"):
            sessions = lake.session.select(SESSION_COLUMNS)
            return with_session(lake.event if self.table == "es" else lake.message, sessions)
        return getattr(lake, self.table)

    def run(self, spark: SparkSession, folder: str, types: tuple[str, ...] | None = None) -> DataFrame:
        df, prefix = self.frame(Lake(spark, folder)), "s_" if self.table in ("es", "ms") else ""
        if self.time:
            df = df.where((filters.between_closed if self.closed else filters.between)(self.time, START, END))
        if self.valid:
            df = df.where(F.col(f"{prefix}invalid_reason").isNull())
        df = filters.active_types(df, types, f"{prefix}target_type")
        cast = {k: e if e.startswith(("max(", "min(")) else f"cast({e} AS bigint)" for k, e in self.rollup.measures.items()}
        return Rollup(cast, self.rollup.keys, self.rollup.where, self.rollup.order).of(df)

    def sql(self, types: tuple[str, ...] | None = None) -> str:
        prefix = "s_" if self.table in ("es", "ms") else ""
        fact = {"es": "event", "ms": "message"}.get(self.table)
        side = ", ".join(f"session.{c} AS s_{c}" for c in SESSION_COLUMNS)
        source = f"(SELECT {fact}.*, {side} FROM {fact} JOIN session ON {fact}.session_id = session.id)" if fact else self.table
        tests = [self.rollup.where]
        if self.time:
            tests.append(f"{self.time} >= TIMESTAMP '{START}' AND {self.time} {'<=' if self.closed else '<'} TIMESTAMP '{END}'")
        if self.valid:
            tests.append(f"{prefix}invalid_reason IS NULL")
        if types is not None:
            tests.append(f"{prefix}target_type IN ({', '.join(repr(t) for t in types)})" if types else "false")
        columns = [f"{e} AS {k}" for k, e in self.rollup.keys.items()] + [f"{e} AS {k}" if e.startswith(("max(", "min(")) else f"CAST({e} AS BIGINT) AS {k}" for k, e in self.rollup.measures.items()]
        group = f" GROUP BY {', '.join(self.rollup.keys.values())}" if self.rollup.keys else ""
        return with_tables(f"SELECT {', '.join(columns)} FROM {source} WHERE {' AND '.join(f'({t})' for t in tests)}{group}")


def es(measures: dict, keys: dict | None = None, where: str = COUNTED, order: tuple = ()) -> Query:
    return Query("es", Rollup(measures, keys or {}, where, order), "event_time")


def ev(measures: dict, keys: dict | None = None, where: str = "true", time: str | None = "event_time") -> Query:
    return Query("event", Rollup(measures, keys or {}, where), time, valid=False)


def ms(measures: dict, keys: dict | None = None, where: str = "true", time: str | None = "message_time") -> Query:
    return Query("ms", Rollup(measures, keys or {}, where), time)


def me(measures: dict, keys: dict | None = None, where: str = "true", time: str | None = None) -> Query:
    return Query("message", Rollup(measures, keys or {}, where), time, valid=False)


def se(measures: dict, keys: dict | None = None, where: str = "true", time: str | None = "last_activity") -> Query:
    return Query("session", Rollup(measures, keys or {}, where), time)


def of(table: str, measures: dict, keys: dict | None = None, where: str = "true", time: str | None = None) -> Query:
    return Query(table, Rollup(measures, keys or {}, where), time, valid=False)


TM = {"tokens": TOKENS, "messages": MESSAGES}
USER_ROWS = {"user_messages": f"sum(CASE WHEN {ROLE} = 'user' THEN 1 ELSE 0 END)", "assistant_messages": f"sum(CASE WHEN {ROLE} = 'assistant' THEN 1 ELSE 0 END)", "slash_count": f"sum(CASE WHEN {ROLE} = 'user' THEN coalesce(slash_command_count, 0) + coalesce(slash_skill_count, 0) ELSE 0 END)"}
SUMS = {"user_messages": "sum(user_messages)", "assistant_messages": "sum(assistant_messages)"}
IO = {"input_tokens": "sum(input_tokens)", "output_tokens": "sum(output_tokens)"}
MESSAGE_IO = {"input_tokens": "coalesce(sum(input_tokens), 0)", "output_tokens": "coalesce(sum(output_tokens), 0)", "n": "count(*)"}
OVERVIEW = {k: f"coalesce(sum(CASE WHEN {COUNTED} THEN {c} END), 0)" for k, c in (("input_tokens", "input_tokens_delta"), ("output_tokens", "output_tokens_delta"), ("messages", "messages_delta"))} | {
    "sessions": f"count(DISTINCT CASE WHEN {COUNTED} THEN session_id END)", "users": f"count(DISTINCT CASE WHEN {COUNTED} THEN user_code END)",
    "projects": f"count(DISTINCT CASE WHEN {COUNTED} THEN s_project_name END)", "tool_calls": f"sum(CASE WHEN {TOOL} THEN 1 ELSE 0 END)"}

#: Queries that exist with and without the filter on active types.
PAIRED: dict[str, Query] = {
    "agg_e1": Query("es", Rollup({"calls": "count(*)", "users": USER_N, "sessions": SESSION_N}, {"tool_name": "tool_name"}, TOOL, ("calls desc", "tool_name")), "event_time", closed=True),
    "agg_e2": es({"calls": "count(*)"}, {"tool_name": "tool_name"}, f"{TOOL} AND user_code = '{USER}'", ("calls desc", "tool_name")),
    "agg_e4": es({"calls": "count(*)"}, where=TOOL),
    "agg_e5": es(BOTH | {"messages": MESSAGES, "sessions": SESSION_N, "users": USER_N, "projects": PROJECT_N}),
    "agg_e7": es(TM | {"sessions": SESSION_N, "projects": PROJECT_N}, {"user_code": "user_code"}, order=("tokens desc", "sessions desc", "user_code")),
    "agg_e8": es(TM | {"sessions": SESSION_N, "users": USER_N}, {"project_name": "s_project_name"}, f"{COUNTED} AND s_project_name IS NOT NULL", ("tokens desc", "project_name")),
    "agg_e10": es(BOTH | {"messages": MESSAGES, "sessions": SESSION_N, "users": USER_N}, {"model": "s_model"}, f"{COUNTED} AND s_model IS NOT NULL"),
    "agg_e11": es(TM | {"sessions": SESSION_N}, {"user_code": "user_code"}, f"{COUNTED} AND s_project_name = '{PROJECT}'", ("tokens desc", "user_code")),
    "agg_e12": es(TM | {"sessions": SESSION_N, "users": USER_N}, DAY, f"{COUNTED} AND s_project_name = '{PROJECT}'", ("day",)),
    "agg_e13": es({"tokens": TOKENS, "sessions": SESSION_N}, {"model": "s_model"}, f"{COUNTED} AND s_project_name = '{PROJECT}'"),
    "agg_e14": es({"tokens": TOKENS}, {"project_name": "s_project_name", "model": "s_model"}),
    "agg_e15": es({"last_time": "max(event_time)", "repo_url": "max(s_repo_url)"}, {"project_name": "s_project_name"}, f"{COUNTED} AND s_project_name IS NOT NULL"),
    "agg_e16": es({"tokens": TOKENS, "sessions": SESSION_N}, {"model": "s_model"}, f"{COUNTED} AND user_code = '{USER}'"),
    "agg_e17": es({"tokens": TOKENS, "sessions": SESSION_N}, {"project_name": "s_project_name"}, f"{COUNTED} AND user_code = '{USER}'"),
    "agg_e18": es({"tokens": TOKENS}, DAY | {"model": "s_model"}),
    "agg_e21": Query("es", Rollup({}, {"user_code": "user_code"}), "event_time"),
    "agg_s1": se(SUMS, {"project_name": "project_name"}, "project_name IS NOT NULL"),
    "agg_s5": se(SUMS, {"user_code": "user_code"}),
    "agg_s6": se({k: f"coalesce({e}, 0)" for k, e in IO.items()}, where=f"user_code = '{USER}'"),
}

SINGLE: dict[str, Query] = {
    "agg_e3": es({"calls": "count(*)"}, {"user_code": "user_code", "session_id": "session_id", "tool_name": "tool_name"}, f"{TOOL} AND lower(substr(tool_name, 1, 5)) = 'mcp__'"),
    "agg_e6": es(OVERVIEW, where="true"),
    "agg_e9": es(TM | {"sessions": SESSION_N, "last_time": "max(event_time)", "repo_url": "max(s_repo_url)"}, {"project_name": "s_project_name", "model": "s_model", "user_code": "user_code"}),
    "agg_e19": ev(TM, where="session_id = 7", time=None),
    "agg_e20": ev(TM, {"session_id": "session_id"}, SESSIONS, None),
    "agg_e22": ev({}, {"event_type": "event_type"}, "session_id = 7", None),
    "agg_e23": ev({"last_time": "max(event_time)"}, DAY, COUNTED),
    "agg_e24": ev({"n": "count(*)"}, {"event_type": "event_type"}),
    "agg_m1": me({"n": "count(*)"}, {"role": "lower(role)"}, "session_id = 7"),
    "agg_m2": me({"last_seq": "coalesce(max(seq), 0)"}, where="session_id = 7"),
    "agg_m3": me({"input_tokens": "coalesce(sum(input_tokens), 0)", "output_tokens": "coalesce(sum(output_tokens), 0)", "n": "count(*)"}, where=SESSIONS, time="message_time"),
    "agg_m4": me({"input_tokens": "coalesce(sum(input_tokens), 0)", "output_tokens": "coalesce(sum(output_tokens), 0)", "n": "count(*)"}, where=f"{SESSIONS} AND {ROLE} IN ('user', 'assistant', 'subagent')", time="message_time"),
    "agg_m5": me({"n": "count(*)"}, {"user_code": "user_code", "role": ROLE}, time="message_time"),
    "agg_m6": ms(USER_ROWS, {"user_code": "user_code"}),
    "agg_m7": me({"n": "count(*)"}, {"role": ROLE}, f"user_code = '{USER}'", "message_time"),
    "agg_m8": ms(USER_ROWS, {"day": "cast(message_time AS date)"}, f"user_code = '{USER}'"),
    "agg_m9": ms({"commands": "coalesce(sum(slash_command_count), 0)", "skills": "coalesce(sum(slash_skill_count), 0)"}, {"user_code": "user_code"}, SESSIONS, None),
    "agg_e20_all": ev(TM, {"session_id": "session_id"}, time=None),
    "agg_m3_all": me(MESSAGE_IO, {"session_id": "session_id"}, time="message_time"),
    "agg_m4_all": me(MESSAGE_IO, {"session_id": "session_id"}, f"{ROLE} IN ('user', 'assistant', 'subagent')", "message_time"),
    "agg_m9_all": ms({"commands": "coalesce(sum(slash_command_count), 0)", "skills": "coalesce(sum(slash_skill_count), 0)"}, {"session_id": "session_id", "user_code": "user_code"}, time=None),
    "agg_m12": me({}, {"session_id": "session_id"}, "position('skill.md' IN lower(content_text)) > 0"),
    "agg_m13": of("commit_file", {"files": "count(*)", "with_patch": "sum(CASE WHEN has_patch THEN 1 ELSE 0 END)"}, {"commit_id": "commit_id"}),
    "agg_s2": se(IO, {"project_name": "project_name"}, "project_name IS NOT NULL"),
    "agg_s3": se(IO, {"user_code": "user_code"}),
    "agg_s4": se(SUMS | IO, {"user_code": "user_code"}, f"project_name = '{PROJECT}'"),
    "agg_s7": se({"n": "count(*)"}, {"target_type": "target_type"}),
    "agg_s8": Query("session", Rollup({"sessions": "count(*)", "agents": "count(DISTINCT agent_id)"}, where="status <> 'idle'")),
    "agg_s10": se({"n": "count(*)"}, {"user_code": "user_code", "target_type": "target_type"}),
    "agg_g5": of("commits", {"n": "count(*)"}, {"repo_url": "repo_url", "user_code": "user_code"}, time="commit_time"),
    "agg_g6": of("commits", {"first_time": "min(commit_time)"}),
    "agg_w1": of("work", {"duration_seconds": "coalesce(sum(duration_seconds), 0)", "active_seconds": "coalesce(sum(active_seconds), 0)"}, where="cast(end_time AS date) >= DATE '2024-01-15'"),
}


def bound(query: Query, types: tuple[str, ...] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query.run(spark, folder, types)


QUERIES = {k: bound(q) for k, q in (PAIRED | SINGLE).items()} | {f"{k}_active": bound(q, ACTIVE) for k, q in PAIRED.items()} | {"agg_e5_no_active_types": bound(PAIRED["agg_e5"], ())}
ORACLES = {k: q.sql() for k, q in (PAIRED | SINGLE).items()} | {f"{k}_active": q.sql(ACTIVE) for k, q in PAIRED.items()} | {"agg_e5_no_active_types": PAIRED["agg_e5"].sql(())}
