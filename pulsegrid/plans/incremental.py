"""MAT-3, MAT-6: the daily summary and the attribution built in two goes, the second only for what late rows touch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import attribution
from pulsegrid.operators.joins import minutes
from pulsegrid.shared import own_folder
from pulsegrid.streaming.rebuild import PAIR, Builds

from .analysis import ATTRIBUTION, TOOLS
from .behaviour import DAILY, daily_summary
from .bindings import Lake
from .registry import Registry

query = Registry()
NOW = datetime(2024, 2, 1)
ALL = 1 << 30  # pairs of one lease


@query("mat_6_incremental", f"WITH {DAILY} SELECT work_date, user_code, sessions, tool_calls, tokens, active_seconds, retries, top_models FROM daily")
def mat_6_incremental(t: Lake) -> DataFrame:
    """Daily summaries of most signals; then the others come, and the days of their users are built anew from all signals."""
    names = ["sessions", "tool_calls", "tokens", "active_seconds", "retries", "top_models"]
    kinds = dict(daily_summary(t.activity).dtypes)
    builds = Builds(t.spark, own_folder(t.spark, "summaries"), ", ".join(f"{n} {kinds[n]}" for n in names))
    day = F.to_date("signal_time").alias("work_date")
    early = t.activity.where("event_type <> 'purchase'")

    def building(rows: DataFrame):
        return lambda pairs: daily_summary(rows.join(pairs, (F.to_date("signal_time") == pairs["work_date"]) & (rows["user_code"] == pairs["user_code"]), "left_semi")).select(*PAIR, *names)

    for batch, (came, known) in enumerate([(early, early), (t.activity.where("event_type = 'purchase'"), t.activity)]):
        builds.mark(came.select(day, "user_code"), "signals", batch)
        builds.run("nightly", lambda: NOW, building(known), ALL)
    return builds.results().select(*PAIR, *names)


@query("mat_3_incremental", f"WITH {ATTRIBUTION} SELECT CAST(commit_time AS DATE) AS work_date, user_code, id, tier, tool, session_id, model, overlap_seconds FROM attribution")
def mat_3_incremental(t: Lake) -> DataFrame:
    """Commits attributed with most sessions known; then the others come, and the days that they reach into are attributed anew."""
    names = {"id": "long", "tier": "string", "tool": "string", "session_id": "long", "model": "string", "overlap_seconds": "long"}
    builds = Builds(t.spark, own_folder(t.spark, "attribution"), ", ".join(f"{n} {k}" for n, k in names.items()))
    day = F.to_date("commit_time").alias("work_date")
    late = t.session.where("id % 5 = 0")
    reach = F.explode(F.sequence(F.to_date(F.col("started_at") - minutes(30)), F.to_date(F.col("last_activity") + minutes(30)))).alias("work_date")

    def building(sessions: DataFrame):
        def build(pairs: DataFrame) -> DataFrame:
            commits = t.commits
            some = commits.join(pairs, (F.to_date("commit_time") == pairs["work_date"]) & (commits["user_code"] == pairs["user_code"]), "left_semi")
            return attribution.attribute(some, sessions, t.event, TOOLS).select(day, "user_code", *names)

        return build

    steps = [(t.commits.select(day, "user_code"), t.session.where("id % 5 <> 0")), (late.select(reach, "user_code"), t.session)]
    for batch, (came, known) in enumerate(steps):
        builds.mark(came, "ingest", batch)
        builds.run("nightly", lambda: NOW, building(known), ALL)
    return builds.results().select(*PAIR, *names)


QUERIES, ORACLES = query.queries, query.oracles
