"""Predicates over sessions, events, messages and devices (FLT)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTED_EVENTS = ("SESSION_OPEN", "TOKEN_DELTA", "MESSAGE_DELTA")


def valid(df: DataFrame) -> DataFrame:
    """Sessions that were not marked invalid."""
    return df.where(F.col("invalid_reason").isNull())


def active_types(df: DataFrame, types: Iterable[str] | None, column: str = "target_type") -> DataFrame:
    """Rows of the given types; None means no filter, an empty list no rows."""
    if types is None:
        return df
    wanted = sorted({t.lower() for t in types})
    return df.where(F.col(column).isin(wanted)) if wanted else df.where(F.lit(False))


def between(column: str, start: str, end: str) -> Column:
    """The half-open range that most windows use."""
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


def between_closed(column: str, start: str, end: str) -> Column:
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def touches(start: str, end: str) -> Column:
    """Sessions that started in the window or were last active in it; one that spans all of it is left out."""
    return between("started_at", start, end) | between("last_activity", start, end)


def overlaps(start: str, end: str) -> Column:
    return (F.col("started_at") <= F.lit(end).cast("timestamp_ntz")) & (F.col("last_activity") >= F.lit(start).cast("timestamp_ntz"))


def counted_events() -> Column:
    return F.col("event_type").isin(*COUNTED_EVENTS)


def role() -> Column:
    """Roles compare without case and outer blanks."""
    return F.lower(F.trim("role"))


def has_hits(column: str = "slash_hits_json") -> Column:
    """A JSON array with something in it."""
    return F.coalesce(F.trim(column), F.lit("")).isin("", "[]", "null") == F.lit(False)


def optional(column: str, value: object | None) -> Column:
    """Equality if a value is given."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def any_nonzero(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in columns])


def online(now: str, seconds: int = 300) -> Column:
    return (F.col("status") == "ACTIVE") & (F.col("last_seen") > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))


def offline(now: str, seconds: int = 300) -> Column:
    return (F.col("status") == "ACTIVE") & (F.col("last_seen").isNull() | (F.col("last_seen") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))))


#: Openings of user texts that are echoes of local commands.
COMMAND_ECHOES = ("<local-command-", "<command-name>", "<command-message>", "<command-args>", "Unknown command:")


def local_command(column: str = "content_text") -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in COMMAND_ECHOES]), F.lit(False))


def needs_audit(now: str, grown_by: int = 5) -> Column:
    """FLT-16, over sessions left-joined with their audit state and audit (_a: its session): never or not yet audited,
    given up or overdue, to be audited again, or audited but grown since or without a result."""
    state = F.coalesce("state", F.lit("NONE"))
    overdue = state.isin("RUNNING", "FAILED") & (F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(now).cast("timestamp_ntz")))
    grown = F.coalesce(F.col("total_messages") > F.col("message_count") + grown_by, F.lit(False))
    due = state.isin("NONE", "PENDING") | overdue | F.coalesce("reaudit", F.lit(False)) | (state == "DONE") & (F.col("_a").isNull() | grown)
    return (F.col("total_messages") > 0) & due


def stably_audited(grown_by: int = 5) -> Column:
    """Audited, with a result, not to be audited again, and not grown since; over the same join."""
    same = F.coalesce(F.col("total_messages") <= F.col("message_count") + grown_by, F.lit(False))
    return (F.col("total_messages") > 0) & F.coalesce(F.col("state") == "DONE", F.lit(False)) & ~F.coalesce("reaudit", F.lit(False)) & F.col("_a").isNotNull() & same


def email_due(now: str, threshold_hours: int = 1, gap_hours: int = 2, work_start: int = 9, work_end: int = 18) -> Column:
    """FLT-23: offline for ``threshold_hours``, no mail within ``gap_hours``, an address at hand, and within working hours."""
    moment = F.lit(now).cast("timestamp_ntz")
    working = (F.hour(moment) >= work_start) & (F.hour(moment) < work_end)
    old = F.col("last_seen").isNull() | (F.col("last_seen") <= moment - F.make_dt_interval(hours=F.lit(threshold_hours)))
    quiet = F.col("last_email").isNull() | (F.col("last_email") <= moment - F.make_dt_interval(hours=F.lit(gap_hours)))
    return working & (F.col("status") == "ACTIVE") & old & quiet & address().isNotNull()


def address() -> Column:
    """The user code if it looks like an address, else the one that git knows."""

    def plausible(c: Column) -> Column:
        return F.when(F.trim(c).contains("@") & ~F.trim(c).contains(" "), F.trim(c))

    return F.coalesce(plausible(F.col("user_code")), plausible(F.col("git_email")))
