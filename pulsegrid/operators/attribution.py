"""Attribution of commits to sessions (WIN-9): an interval join and the best candidate of each commit.

The signal of a session for a commit is its last event at or before the commit within the window before
it; a session without one counts from its last activity, unless it started after the commit. Signals
are judged commit by commit, so the result does not depend on how commits are batched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.functions import text

from .joins import band, minutes
from .sequences import micros


def candidates(commits: DataFrame, sessions: DataFrame, window: int = 30) -> DataFrame:
    """Valid sessions of the commit's user that lie within ``window`` minutes of it; commits have repo, trailer_kind and tool."""
    side = sessions.where("invalid_reason is null").select(F.col("id").alias("s_id"), F.col("user_code").alias("s_user"), F.col("target_type").alias("s_type"), F.col("model").alias("s_model"), F.col("project_name").alias("s_project"), text.norm_repo(F.col("repo_url")).alias("s_repo"), F.col("started_at").alias("s_start"), F.col("last_activity").alias("s_end"))
    return band(commits, side, {"user_code": "s_user"}, "commit_time", F.col("s_start") - minutes(window), F.col("s_end") + minutes(window))


def based(commits: DataFrame, rules: Sequence[tuple] = text.TRAILERS) -> DataFrame:
    """Commits that are no merge, with repo and what their trailer says."""
    body = F.col("message_body")
    return commits.where("is_merge = 0").select("id", "user_code", "commit_time", "lines_added", "lines_deleted", text.norm_repo(F.col("repo_url")).alias("repo"), text.trailer(body, "kind", rules).alias("trailer_kind"), text.trailer(body, "tool", rules).alias("rule_tool"))


def placed(commits: DataFrame, sessions: DataFrame, events: DataFrame, tools: dict[str, str] | None = None, window: int = 30, rules: Sequence[tuple] = text.TRAILERS) -> DataFrame:
    """Commits and the sessions that may have made them: signals, last_signal (of this commit's window), overlap and signal."""
    kind = F.coalesce(*[F.when(F.col("s_type") == k, v) for k, v in (tools or {}).items()], F.col("s_type"))
    found = candidates(based(commits, rules), sessions, window).withColumn("s_tool", kind)
    same_repo = F.coalesce(F.col("repo") == F.col("s_repo"), F.lit(False))
    found = found.where(F.when(F.col("trailer_kind").isNotNull(), F.col("rule_tool").isNull() | (F.col("s_tool") == F.col("rule_tool"))).otherwise(same_repo)).withColumn("same_repo", same_repo)
    last = with_signals(found.select("id", "s_id", "commit_time", "s_start", "s_end", "s_model", "s_project", "s_tool", "same_repo"), events, window)
    fallback = F.when(F.col("s_start") <= F.col("commit_time"), F.least("s_end", "commit_time"))
    overlap = F.floor((F.least(micros(F.col("s_end")), micros(F.col("commit_time") + minutes(window))) - F.greatest(micros(F.col("s_start")), micros(F.col("commit_time") - minutes(window)))) / 1_000_000)
    return last.withColumns({"signal": F.coalesce("last_signal", fallback), "overlap": F.greatest(F.lit(0), overlap)})


def with_signals(pairs: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """Pairs of commit and session (id, s_id, commit_time, ...) with last_signal and signals, the session's events in the window before the commit.

    Each pair puts two marks among the session's events, where its window begins and ends; what is between them is told by
    running counts. So a session is sorted once and has as many rows as events and marks, however many commits meet how many events;
    the marks of a pair meet where their session is, so they are not dealt out again.
    """
    begin = micros(F.col("commit_time")) - window * 60_000_000
    pair = F.struct(*pairs.columns)
    marks = pairs.select("s_id", F.inline(F.array(*[F.struct(at.alias("at"), F.lit(kind).alias("kind"), pair.alias("pair")) for at, kind in ((begin, 0), (micros(F.col("commit_time")), 2))])))
    rows = events.select(F.col("session_id").alias("s_id"), micros(F.col("event_time")).alias("at"), F.lit(1).alias("kind"), F.col("event_time").alias("e_time"))
    every = marks.unionByName(rows, allowMissingColumns=True)
    upto = W.partitionBy("s_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    told = every.withColumns({"n": F.count("e_time").over(upto), "last": F.last("e_time", True).over(upto)}).where("kind <> 1")
    found = told.groupBy("s_id", "pair").agg((F.max("n") - F.min("n")).alias("signals"), F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("last"))
    return found.select("pair.*", "signals", F.when(F.col("signals") > 0, F.col("last")).alias("last_signal"))


def signals(commits: DataFrame, sessions: DataFrame, events: DataFrame, tools: dict[str, str] | None = None) -> DataFrame:
    """WIN-10: how many signals of a session count for a commit, and the last of them."""
    return placed(commits, sessions, events, tools).select("id", F.col("s_id").alias("session_id"), "signals", "last_signal")


def nearest(ranked: DataFrame) -> DataFrame:
    """JN-11: of a commit's sessions the one in its repository, with the latest signal, the longest overlap, the least id."""
    best = W.partitionBy("id").orderBy(F.desc("same_repo"), F.desc_nulls_last("signal"), F.desc("overlap"), "s_id")
    top = ranked.withColumn("n", F.row_number().over(best)).where("n = 1")
    return top.select("id", F.col("s_id").alias("session_id"), "s_model", "s_tool", F.col("s_project").alias("project_name"), "signal", F.col("overlap").alias("overlap_seconds"))


def attribute(commits: DataFrame, sessions: DataFrame, events: DataFrame, tools: dict[str, str] | None = None, window: int = 30, rules: Sequence[tuple] = text.TRAILERS) -> DataFrame:
    """One row per commit that is no merge: id, tier (B trailer, A same repository, NONE), trailer_kind, tool, session_id, project_name, model, overlap_seconds.

    ``tools`` maps the session's type to the tool that a trailer names (identity if not given). A trailer's commit
    takes a session of its tool (of any tool, if the rule names none), of its own repository if there is one. Model and project are the session's;
    a trailer without a session has the model ``unknown``.
    """
    top = nearest(placed(commits, sessions, events, tools, window, rules))
    tier = F.when(F.col("trailer_kind").isNotNull(), "B").when(F.col("session_id").isNotNull(), "A").otherwise("NONE")
    model = F.when(F.col("session_id").isNotNull(), F.col("s_model")).when(F.col("trailer_kind").isNotNull(), "unknown")
    return based(commits, rules).join(top, "id", "left").select("id", "user_code", "commit_time", "lines_added", "lines_deleted", tier.alias("tier"), "trailer_kind", F.coalesce("rule_tool", "s_tool").alias("tool"), "session_id", "project_name", model.alias("model"), F.coalesce("overlap_seconds", F.lit(0)).alias("overlap_seconds"))
