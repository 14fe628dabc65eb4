"""What a console asks for, by path and with parameters (the read functions of the inventory).

``entrypoints.call(spark, folder, path, ...)`` checks and converts the parameters and answers with a table. Days are ISO
dates, a window is closed on both ends and stops at ``today``; numbers are kept within their bounds, as the console
expects; a parameter that is not known is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.functions import text
from pulsegrid.operators import filters, hits, shapes

from .analysis import analysis, attributed
from .behaviour import capabilities, summary
from .bindings import Lake
from .registry import Registry
from .relational import audited

query = Registry()


@dataclass(frozen=True)
class Day:
    """An ISO date; ``back``: by default so many days before today."""

    back: int = 0

    def __call__(self, value: object, today: date) -> date:
        return today - timedelta(days=self.back) if value is None else value if isinstance(value, date) else date.fromisoformat(str(value))


@dataclass(frozen=True)
class Number:
    """A number kept within its bounds."""

    default: int
    least: int = 1
    most: int = 500

    def __call__(self, value: object, today: date) -> int:
        return min(max(int(self.default if value is None else value), self.least), self.most)


@dataclass(frozen=True)
class Word:
    """Text, one of ``of`` if there are any."""

    default: str | None = None
    of: tuple[str, ...] = ()
    needed: bool = False

    def __call__(self, value: object, today: date) -> str | None:
        found = self.default if value is None else str(value)
        if self.needed and found is None or self.of and found is not None and found not in self.of:
            raise ValueError(f"expected {'one of ' + ', '.join(self.of) if self.of else 'a value'}: {found}")
        return found


@dataclass(frozen=True)
class Words:
    """A list of words, each one of ``of``."""

    default: tuple[str, ...] = ()
    of: tuple[str, ...] = ()

    def __call__(self, value: object, today: date) -> list[str]:
        found = list(self.default if value is None else value.split(",") if isinstance(value, str) else value)
        if self.of and not set(found) <= set(self.of):
            raise ValueError(f"expected some of {', '.join(self.of)}: {found}")
        return found


@dataclass(frozen=True)
class Call:
    function: Callable[..., DataFrame]
    parameters: dict[str, Callable]


CALLS: dict[str, Call] = {}


def call(path: str, **parameters: Callable) -> Callable:
    """Register a function of a lake as the answer to ``path``."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CALLS[path] = Call(function, {"today": Day(), **parameters})
        return function

    return add


def answer(t: Lake, path: str, **given: object) -> DataFrame:
    found = CALLS[path]
    if unknown := given.keys() - found.parameters.keys():
        raise TypeError(f"{path} has no {', '.join(sorted(unknown))}")
    today = Day()(given.get("today"), date.today())
    values = {name: kind(given.get(name), today) for name, kind in found.parameters.items()}
    return found.function(t, **values)


WINDOW = {"first": Day(6), "last": Day()}


def inside(column: str, first: date, last: date, today: date) -> Column:
    """Whether a time lies in the window as far as it has passed."""
    return filters.between(column, first.isoformat(), (min(last, today) + timedelta(days=1)).isoformat())


def elapsed(first: date, last: date, today: date) -> int:
    return max(0, (min(last, today) - first).days + 1)


# ---- overview


@call("dashboard/overview")
def overview(t: Lake, today: date) -> DataFrame:
    """One row: sessions that are not idle, and what the day's events add up to."""
    events = t.event.where(inside("event_time", today, today, today)).join(filters.valid(t.session).select(F.col("id").alias("session_id"), "project_name"), "session_id")
    day = events.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("input_tokens_delta", "input_tokens"), ("output_tokens_delta", "output_tokens"), ("messages_delta", "messages"))], *[F.count_distinct(c).alias(n) for c, n in (("session_id", "sessions"), ("user_code", "users"), ("project_name", "projects"))], F.count_if(F.col("event_type") == "TOOL_CALL").alias("tool_calls"))
    return day.crossJoin(t.session.where("status <> 'idle'").agg(F.count(F.lit(1)).alias("active_sessions")))  # one row each


@call("dashboard/token-trend", days=Number(30, 1, 90))
def token_trend(t: Lake, today: date, days: int) -> DataFrame:
    first = (today - timedelta(days=days - 1)).isoformat()
    daily = summary(t).where(F.col("work_date").between(F.lit(first).cast("date"), F.lit(today.isoformat()).cast("date"))).groupBy(F.col("work_date").alias("day")).agg(F.sum("tokens").alias("tokens"))
    return shapes.gap_filled(daily, "day", ["tokens"], first, today.isoformat())


@call("dashboard/ai-penetration", window=Word("30d", ("today", "7d", "30d")))
def penetration(t: Lake, today: date, window: str) -> DataFrame:
    """Percent of lines in commits that a tool had a hand in; -1 without any."""
    days = {"today": 1, "7d": 7, "30d": 30}[window]
    lines = attributed(t).where(inside("commit_time", today - timedelta(days=days - 1), today, today))
    ai, whole = F.sum(F.when(F.col("tier") != "NONE", F.col("lines_added"))), F.sum("lines_added")
    return lines.agg(F.when(whole > 0, text.java_round(F.coalesce(ai, F.lit(0)) * 100.0 / whole).cast("long")).otherwise(-1).alias("percent"))


@call("dashboard/insight-audit")
def audit_progress(t: Lake, today: date) -> DataFrame:
    now = f"{today.isoformat()} 23:59:59"
    return audited(t).agg(F.count_if(filters.needs_audit(now)).alias("pending"), F.count_if(filters.stably_audited()).alias("stable"))


# ---- people, projects, models, tools


@call("people", **WINDOW)
def people(t: Lake, today: date, first: date, last: date) -> DataFrame:
    """A row for each user with a summary in the window."""
    days = F.lit(max(1, elapsed(first, last, today)))
    rows = summary(t).where(F.col("work_date").between(F.lit(first), F.lit(min(last, today))))
    answered = F.nullif(F.count_if(F.col("first_response_ms") > 0), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("sessions", "tokens", "user_messages", "assistant_messages", "retries")]
    return rows.groupBy("user_code").agg(F.count(F.lit(1)).alias("days_with_data"), *sums, F.floor(F.sum("active_seconds") / days).alias("active_per_day"), F.floor(F.sum("first_response_ms") / answered).alias("first_response_ms"))


@call("people/one", user=Word(needed=True), **WINDOW)
def person(t: Lake, today: date, user: str, first: date, last: date) -> DataFrame:
    """The user's days in the window."""
    return summary(t).where((F.col("user_code") == user) & F.col("work_date").between(F.lit(first), F.lit(min(last, today)))).orderBy("work_date")


COMMIT_ROW = ["id", "user_code", "commit_hash", "repo_url", "project_name", "commit_time", "lines_added", "lines_deleted", "message_subject"]


@call("people/one/git-commits", user=Word(needed=True), limit=Number(200), **WINDOW)
def person_commits(t: Lake, today: date, user: str, limit: int, first: date, last: date) -> DataFrame:
    rows = t.commits.where((F.col("user_code") == user) & inside("commit_time", first, last, today))
    return rows.select(COMMIT_ROW).orderBy(F.desc("commit_time"), F.desc("id")).limit(limit)


@call("people/one/slash-commands", user=Word(needed=True), limit=Number(100), **WINDOW)
def person_commands(t: Lake, today: date, user: str, limit: int, first: date, last: date) -> DataFrame:
    rows = t.message.where((F.col("user_code") == user) & inside("message_time", first, last, today))
    return hits.ranking(rows).orderBy(F.desc("uses"), "token").limit(limit)


@call("projects", limit=Number(100, 1, 1_000), **WINDOW)
def projects(t: Lake, today: date, limit: int, first: date, last: date) -> DataFrame:
    sessions = filters.valid(t.session).where("project_name is not null").select(F.col("id").alias("session_id"), "project_name")
    events = t.event.where(inside("event_time", first, last, today)).join(sessions, "session_id")
    return events.groupBy("project_name").agg(F.sum("tokens_delta").alias("tokens"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("user_code").alias("users"), F.max("event_time").alias("last_time")).orderBy(F.desc("tokens"), "project_name").limit(limit)


@call("projects/one", project=Word(needed=True), **WINDOW)
def project(t: Lake, today: date, project: str, first: date, last: date) -> DataFrame:
    """A project's tokens and sessions by user and model."""
    sessions = filters.valid(t.session).where(F.col("project_name") == project).select(F.col("id").alias("session_id"), "model")
    events = t.event.where(inside("event_time", first, last, today)).join(sessions, "session_id")
    return events.groupBy("user_code", "model").agg(F.sum("tokens_delta").alias("tokens"), F.count_distinct("session_id").alias("sessions"))


@call("projects/one/git-commits", project=Word(needed=True), limit=Number(200), **WINDOW)
def project_commits(t: Lake, today: date, project: str, limit: int, first: date, last: date) -> DataFrame:
    rows = t.commits.where((F.col("project_name") == project) & inside("commit_time", first, last, today))
    return rows.select(COMMIT_ROW).orderBy(F.desc("commit_time"), F.desc("id")).limit(limit)


@call("models/distribution", user=Word(), project=Word(), **WINDOW)
def models(t: Lake, today: date, user: str | None, project: str | None, first: date, last: date) -> DataFrame:
    sessions = filters.valid(t.session).where(filters.optional("project_name", project)).select(F.col("id").alias("session_id"), F.coalesce("model", F.lit("unknown")).alias("model"))
    events = t.event.where(inside("event_time", first, last, today) & filters.optional("user_code", user)).join(sessions, "session_id")
    return events.groupBy("model").agg(F.sum("tokens_delta").alias("tokens"), F.count_distinct("session_id").alias("sessions"))


@call("stats/tools", user=Word(), limit=Number(50), **WINDOW)
def tools(t: Lake, today: date, user: str | None, limit: int, first: date, last: date) -> DataFrame:
    calls = t.event.where((F.col("event_type") == "TOOL_CALL") & F.col("tool_name").isNotNull() & inside("event_time", first, last, today) & filters.optional("user_code", user))
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions")).orderBy(F.desc("calls"), "tool_name").limit(limit)


# ---- capabilities, attribution, report

KINDS = ("skill", "nl_skill", "plugin", "mcp")


@call("admin/capability/ranking", kinds=Words(("skill", "nl_skill"), KINDS), limit=Number(20, 1, 200), **WINDOW)
def capability_ranking(t: Lake, today: date, kinds: list[str], limit: int, first: date, last: date) -> DataFrame:
    return hits.capability_ranking(capabilities(t).where(F.col("work_date").between(F.lit(first), F.lit(min(last, today)))), kinds, limit)


@call("admin/capability/user", user=Word(needed=True), **WINDOW)
def capability_user(t: Lake, today: date, user: str, first: date, last: date) -> DataFrame:
    rows = capabilities(t).where((F.col("user_code") == user) & F.col("work_date").between(F.lit(first), F.lit(min(last, today))))
    return rows.groupBy("kind", "item", "sub_item").agg(F.sum("invoke_count").alias("invoke_count"), F.sum("session_count").alias("session_count"))


DIMENSIONS = ("user_code", "project_name", "tool", "model")
CHOICES = {"user": "user_code", "project": "project_name", "tool": "tool", "model": "model", "tier": "tier"}


def chosen(t: Lake, today: date, first: date, last: date, **only: str | None) -> DataFrame:
    rows = attributed(t).where(inside("commit_time", first, last, today))
    for name, value in only.items():
        rows = rows.where(filters.optional(CHOICES[name], value))
    return rows


@call("admin/attribution/pivot", by=Words(("user_code",), DIMENSIONS), user=Word(), project=Word(), tool=Word(), model=Word(), **WINDOW)
def attribution_pivot(t: Lake, today: date, by: list[str], first: date, last: date, **only: str | None) -> DataFrame:
    rows = chosen(t, today, first, last, **only)
    return rows.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"))


@call("admin/attribution/commits", user=Word(), project=Word(), tool=Word(), model=Word(), tier=Word(None, ("A", "B", "NONE")), limit=Number(200), **WINDOW)
def attribution_commits(t: Lake, today: date, limit: int, first: date, last: date, **only: str | None) -> DataFrame:
    """Attributed commits with their own columns, newest first."""
    rows = chosen(t, today, first, last, **only).select("id", "user_code", "commit_time", "tier", "tool", "session_id", "model", "overlap_seconds")
    top = rows.orderBy(F.desc("commit_time"), F.desc("id")).limit(limit)
    return top.join(t.commits.select("id", "commit_hash", "message_subject", "lines_added", "lines_deleted"), "id").orderBy(F.desc("commit_time"), F.desc("id"))


@call("admin/analysis", user=Word())
def report(t: Lake, today: date, user: str | None) -> DataFrame:
    return analysis(t).where(filters.optional("user_code", user))


# ---- sessions


def window_tokens(t: Lake, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """What sessions count for in [start, end): window_messages, window_tokens, and which rule says so.

    Sessions with stored messages count the tokens of their conversation in the window; where those are none, their
    whole totals if they lie in the window; else, and without stored messages, what their events add up to.
    """
    said = filters.role().isin("user", "assistant", "subagent") & filters.between("message_time", start, end)
    spoken = t.message.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("stored"), F.coalesce(F.sum(F.when(said, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias("said_tokens"), F.count_if(said).alias("said"))
    moved = t.event.where(filters.between("event_time", start, end)).groupBy(F.col("session_id").alias("id")).agg(F.sum("tokens_delta").alias("moved_tokens"), F.sum("messages_delta").alias("moved"))
    rows = sessions.join(spoken, "id", "left").join(moved, "id", "left")
    ends = F.coalesce("last_activity", "started_at")
    within = (F.col("started_at") >= F.lit(start).cast("timestamp_ntz")) & (ends < F.lit(end).cast("timestamp_ntz"))
    known, zero = F.coalesce("stored", F.lit(0)) > 0, F.lit(0)
    rule = F.when(known & (F.col("said_tokens") > 0), "messages").when(known & within, "session").otherwise("events")
    rows = rows.withColumn("rule", rule)
    by_events = F.col("rule") == "events"
    tokens = F.when(F.col("rule") == "messages", F.col("said_tokens")).when(F.col("rule") == "session", F.col("input_tokens") + F.col("output_tokens")).otherwise(F.coalesce("moved_tokens", zero))
    messages = F.when(by_events, F.coalesce("moved", zero)).otherwise(F.col("said"))
    return rows.select(*sessions.columns, "rule", tokens.alias("window_tokens"), messages.cast("long").alias("window_messages"))


SESSION = ["id", "external_session_id", "user_code", "target_type", "project_name", "model", "status", "started_at", "last_activity", "input_tokens", "output_tokens"]


@call("ai-sessions", user=Word(), project=Word(), limit=Number(50), after=Number(0, 0, 1 << 62), **WINDOW)
def sessions(t: Lake, today: date, user: str | None, project: str | None, limit: int, after: int, first: date, last: date) -> DataFrame:
    """Sessions that were last active in the window, a page at a time: ids after ``after``."""
    rows = filters.valid(t.session).where(inside("last_activity", first, last, today) & filters.optional("user_code", user) & filters.optional("project_name", project) & (F.col("id") > after))
    return rows.select(SESSION).orderBy("id").limit(limit)


@call("ai-sessions/one", session=Number(0, 0, 1 << 62), **WINDOW)
def session(t: Lake, today: date, session: int, first: date, last: date) -> DataFrame:
    end = (min(last, today) + timedelta(days=1)).isoformat()
    only = Lake.__new__(OneSession)
    only.lake, only.session_id = t, session
    return window_tokens(only, t.session.where(F.col("id") == session).select(SESSION), first.isoformat(), end)


class OneSession(Lake):
    """Messages and events of one session, so that its detail reads no others."""

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self.lake, name).where(F.col("session_id") == self.session_id)


@call("ai-sessions/audit", session=Number(0, 0, 1 << 62))
def session_audit(t: Lake, today: date, session: int) -> DataFrame:
    return t.audit.where(F.col("session_id") == session)


@call("ai-sessions/messages", session=Number(0, 0, 1 << 62), role=Word(), limit=Number(200, 1, 1_000), after=Number(0, 0, 1 << 62))
def session_messages(t: Lake, today: date, session: int, role: str | None, limit: int, after: int) -> DataFrame:
    rows = t.message.where((F.col("session_id") == session) & (F.col("seq") > after))
    if role is not None:
        rows = rows.where(filters.role() == role.lower())
    return rows.select("id", "seq", filters.role().alias("role"), "message_time", "input_tokens", "output_tokens", "content_text").orderBy("seq", "id").limit(limit)


@call("ai-sessions/events", session=Number(0, 0, 1 << 62), kind=Word(), limit=Number(200, 1, 1_000))
def session_events(t: Lake, today: date, session: int, kind: str | None, limit: int) -> DataFrame:
    rows = t.event.where((F.col("session_id") == session) & filters.optional("event_type", kind))
    return rows.select("id", "event_time", "event_type", "status", "tool_name", "tokens_delta", "messages_delta").orderBy(F.desc("event_time"), F.desc("id")).limit(limit)


# ---- whole tables by the rules of single answers, beside their SQL

FROM, TO = "1996-01-01", "1996-07-01"


@query("read_session_tokens", f"""WITH m AS (SELECT session_id, count(*) AS stored, coalesce(sum(input_tokens + output_tokens) FILTER (lower(trim(role)) IN ('user', 'assistant', 'subagent') AND message_time >= TIMESTAMP '{FROM}' AND message_time < TIMESTAMP '{TO}'), 0) AS said_tokens,
      count(*) FILTER (lower(trim(role)) IN ('user', 'assistant', 'subagent') AND message_time >= TIMESTAMP '{FROM}' AND message_time < TIMESTAMP '{TO}') AS said FROM message WHERE session_id % 3 <> 0 GROUP BY 1),
    e AS (SELECT session_id, sum(tokens_delta) AS moved_tokens, sum(messages_delta) AS moved FROM event WHERE event_time >= TIMESTAMP '{FROM}' AND event_time < TIMESTAMP '{TO}' GROUP BY 1),
    x AS (SELECT s.*, CASE WHEN stored > 0 AND said_tokens > 0 THEN 'messages' WHEN stored > 0 AND started_at >= TIMESTAMP '{FROM}' AND last_activity < TIMESTAMP '{TO}' THEN 'session' ELSE 'events' END AS rule, said_tokens, said, moved_tokens, moved
      FROM session s LEFT JOIN m ON m.session_id = s.id LEFT JOIN e ON e.session_id = s.id)
    SELECT id, rule, CAST(CASE rule WHEN 'messages' THEN said_tokens WHEN 'session' THEN input_tokens + output_tokens ELSE coalesce(moved_tokens, 0) END AS BIGINT) AS window_tokens, CAST(CASE rule WHEN 'events' THEN coalesce(moved, 0) ELSE said END AS BIGINT) AS window_messages FROM x""")  # fmt: skip
def read_session_tokens(t: Lake) -> DataFrame:
    """The tokens of every session in a window by the three steps; every third session has no stored messages."""
    fewer = Lake.__new__(Without)
    fewer.lake = t
    return window_tokens(fewer, t.session, FROM, TO).select("id", "rule", "window_tokens", "window_messages")


class Without(Lake):
    """A lake in which every third session never stored messages."""

    def __getattr__(self, name: str) -> DataFrame:
        rows = getattr(self.lake, name)
        return rows.where("session_id % 3 <> 0") if name == "message" else rows


@query("read_commits", f"""SELECT user_code, id, commit_hash, project_name, row_number() OVER (PARTITION BY user_code ORDER BY commit_time DESC, id DESC) AS place FROM commits
    WHERE commit_time >= TIMESTAMP '{FROM}' AND commit_time < TIMESTAMP '{TO}' QUALIFY place <= 500""")  # fmt: skip
def read_commits(t: Lake) -> DataFrame:
    """The commits that ``people/one/git-commits`` lists, for every user at once."""
    rows = t.commits.where(filters.between("commit_time", FROM, TO))
    place = F.row_number().over(W.partitionBy("user_code").orderBy(F.desc("commit_time"), F.desc("id"))).cast("long")
    return rows.select("user_code", "id", "commit_hash", "project_name", place.alias("place")).where("place <= 500")


QUERIES, ORACLES = query.queries, query.oracles
