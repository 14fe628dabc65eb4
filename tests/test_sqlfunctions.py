"""Functions of Spark SQL against the column functions and the read functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pulsegrid import entrypoints, sqlfunctions
from pulsegrid.functions import text

SF = "/root/testdata/sf0.001"
TEXTS = ["HTTPS://Git.x/a.git", "https://git.x/a//", "a.git.git", " ", None, "/skills/Review", "$deploy", "ns:skill", "a:b:c", "mcp__Srv__tool_x", "mcp____broken", " MCP__a__b", "Revert \"x\"", "reverting", "Claude/Model-X-20250101", "m-latest", " /plan now", "revert: y"]


@pytest.mark.parametrize("name, column", [
    ("norm_repo", text.norm_repo), ("first_token", text.first_token), ("mcp_server", text.mcp_server), ("mcp_tool", text.mcp_tool), ("skill_item", text.skill_item),
    ("skill_namespace", text.namespace), ("is_revert", text.is_revert), ("short_model", text.short_model),
])
def test_text_rules(spark, name, column):
    sqlfunctions.register(spark)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", F.expr(f"{name}(t)").alias("sql"), column(F.col("t")).alias("column")).collect()
    assert [(r["t"], r["sql"]) for r in rows] == [(r["t"], r["column"]) for r in rows]


def test_numbers(spark):
    sqlfunctions.register(spark)
    rows = spark.createDataFrame([(x, i) for x in (-2.5, -0.125, 0.5, 1.005, None) for i in (0, 2)], "x double, d int")
    for r in rows.select("x", "d", F.expr("half_up(x, d)").alias("h"), F.expr("unit_range(x)").alias("u"), text.java_round(F.col("x")).alias("whole"), text.java_round(F.col("x"), 2).alias("cents"), text.clamp01(F.col("x")).alias("c")).collect():
        assert (r["h"], r["u"]) == (r["cents"] if r["d"] else r["whole"], r["c"])
    top = (1 << 63) - 1
    sums = spark.createDataFrame([(top, 1), (-top, -top), (2, 3), (None, 1), (-1, None)], "a long, b long").select(F.expr("saturating_add(a, b)").alias("s"), text.saturating_add(F.col("a"), F.col("b")).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in sums)


def test_tables(spark):
    sqlfunctions.register_tables(spark, SF)
    window, days = "DATE '1996-01-01', DATE '1996-12-31'", {"first": date(1996, 1, 1), "last": date(1996, 12, 31), "today": date(1997, 1, 1)}
    for sql, path, given, names in [
        (f"person_commits('u9', {window})", "people/one/git-commits", {"user": "u9"}, ["id", "commit_hash", "message_subject"]),
        (f"project_commits('proj3', {window})", "projects/one/git-commits", {"project": "proj3"}, ["id", "lines_added"]),
        (f"project_totals({window})", "projects", {}, ["project_name", "tokens", "sessions", "users"]),
        (f"tool_calls(NULL, {window})", "stats/tools", {}, ["tool_name", "calls", "sessions"]),
        (f"tool_calls('u9', {window})", "stats/tools", {"user": "u9"}, ["tool_name", "calls"]),
    ]:
        got, want = spark.sql(f"SELECT {', '.join(names)} FROM {sql}").collect(), entrypoints.call(spark, SF, path, **given, **days).select(names).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want, sql
    assert spark.sql("SELECT count(*) FROM session_events(7)").first()[0] == len(entrypoints.call(spark, SF, "ai-sessions/events", session=7).collect())
