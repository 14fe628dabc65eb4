"""Tables built once, signals of long sessions, and that every branch of a rule occurs in the tables it is tested on."""

import random
import shutil
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import attribution
from pulsegrid.plans import MODULES, materialised
from pulsegrid.plans.bindings import Lake

SF = "/root/testdata/sf0.001"
START = datetime(2026, 1, 1)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}


def test_built_once_and_again_when_the_source_changes(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    t, builds = Lake(spark, str(tmp_path)), []

    def build():
        builds.append(1)
        return t.events.groupBy("event_type").count()

    first = materialised.built(t, "kinds", ("events",), build, "event_type").collect()
    assert materialised.built(t, "kinds", ("events",), build, "event_type").collect() == first and len(builds) == 1
    spark.read.parquet(f"{SF}/events.parquet").limit(10).write.parquet(str(tmp_path / "fewer"))
    (tmp_path / "events.parquet").unlink()
    shutil.move(next((tmp_path / "fewer").glob("part-*.parquet")), tmp_path / "events.parquet")
    assert sum(r["count"] for r in materialised.built(t, "kinds", ("events",), build, "event_type").collect()) == 10 and len(builds) == 2


def test_readers_read_the_table(spark):
    """What reads a built table has no join or window of its build in its plan."""
    for name in ("agg_c1", "agg_d5", "st_5", "agg_g3"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan, name


def test_signals_of_a_long_session(spark):
    """1,000 commits and 100,000 events in one session: one sort, as many rows as events and marks."""
    rng = random.Random(9)
    events = [(1, START + timedelta(seconds=rng.randrange(400_000))) for _ in range(100_000)] + [(2, START)]
    times = [START + timedelta(seconds=rng.randrange(-2_000, 402_000)) for _ in range(999)] + [events[0][1]]
    pairs = spark.createDataFrame([(i, 1, at) for i, at in enumerate(times)] + [(0, 2, START + timedelta(minutes=30)), (0, 3, START)], "id long, s_id long, commit_time timestamp_ntz")
    found = attribution.with_signals(pairs, spark.createDataFrame(events, "session_id long, event_time timestamp_ntz"), 30)
    own = {s: sorted(at for i, at in events if i == s) for s in (1, 2, 3)}
    for r in found.collect():
        low, high = bisect_left(own[r["s_id"]], r["commit_time"] - timedelta(minutes=30)), bisect_right(own[r["s_id"]], r["commit_time"])
        assert (r["signals"], r["last_signal"]) == (high - low, own[r["s_id"]][high - 1] if high > low else None)
    assert found.count() == 1_002
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, column, wanted", [
    ("str_6", "reason", {None, "merged_subagent", "local_command_only", "no_assistant_reply"}),
    ("src_21_sessions", "invalid_reason", {None, "merged_subagent", "no_assistant_reply"}),
    ("src_21_events", "event_type", {"SESSION_OPEN", "STATUS_CHANGE", "TOKEN_DELTA", "MESSAGE_DELTA", "TOOL_CALL"}),
    ("snk_5", "half", {0, 1}),
    ("snk_3", "external_id", {0, 1, 2, 3, 4}),
    ("agg_c7", "kind", {"skill", "nl_skill", "plugin", "mcp"}),
])
def test_branches_occur(spark, name, column, wanted):
    assert wanted <= {r[0] for r in QUERIES[name](spark, SF).select(column).distinct().collect()}


def test_every_cause_of_an_audit_occurs(spark):
    from pulsegrid.operators import filters
    from pulsegrid.plans.relational import NOW, audited

    rows = audited(Lake(spark, SF)).withColumn("due", filters.needs_audit(NOW)).withColumn("over", F.col("lease_until") < F.lit(NOW).cast("timestamp_ntz"))
    seen = {tuple(r) for r in rows.select("state", "over", "reaudit", F.col("_a").isNotNull(), (F.col("total_messages") > F.col("message_count") + 5), "due").distinct().collect()}
    due = {r[:5] for r in seen if r[5]}
    assert {r[0] for r in due} == {None, "NONE", "PENDING", "RUNNING", "FAILED", "DONE"}
    assert {r[0] for r in seen if not r[5] and r[0]} >= {"RUNNING", "FAILED", "DONE"}
    assert any(r[0] == "DONE" and r[2] for r in due) and any(r[0] == "DONE" and not r[3] for r in due) and any(r[0] == "DONE" and r[4] and not r[2] for r in due)
