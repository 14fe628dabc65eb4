"""Read functions with parameters."""

import datetime

import duckdb
import pytest

from pulsegrid import entrypoints
from pulsegrid.plans import reads
from pulsegrid.plans.bindings import Lake, with_tables

SF = "/root/testdata/sf0.001"
YEAR = {"first": "1996-01-01", "last": "1996-12-31", "today": "1997-06-01"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return lambda sql: con.execute(with_tables(sql)).fetchall()


@pytest.fixture
def ask(spark):
    return lambda path, **given: entrypoints.call(spark, SF, path, **given).collect()


def test_every_path_answers(ask):
    needed = {"user": "u7", "project": "proj3", "session": 7}
    for path, known in reads.CALLS.items():
        given = {k: v for k, v in needed.items() if k in known.parameters} | {k: v for k, v in YEAR.items() if k in known.parameters}
        assert isinstance(ask(path, **given), list), path


def test_sessions_by_each_of_three_steps(spark, ask, duck):
    """One session for each step of the choice of its tokens."""
    rows = reads.read_session_tokens(Lake(spark, SF)).collect()
    assert {r["rule"] for r in rows} == {"messages", "session", "events"}
    found = ask("ai-sessions/one", session=4, first="1992-01-01", last="1999-12-31", today="2000-01-01")[0]
    said = duck("SELECT sum(input_tokens + output_tokens), count(*) FROM message WHERE session_id = 4 AND lower(trim(role)) IN ('user', 'assistant')")[0]
    assert (found["rule"], found["window_tokens"], found["window_messages"]) == ("messages", *said)
    quiet = ask("ai-sessions/one", session=4, first="1970-01-01", last="1970-01-02", today="2000-01-01")[0]
    assert (quiet["rule"], quiet["window_tokens"], quiet["window_messages"]) == ("events", 0, 0)


def test_windows_and_limits(ask, duck):
    user = duck("SELECT user_code, count(*) FROM commits WHERE commit_time >= TIMESTAMP '1996-01-01' AND commit_time < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")[0]
    rows = ask("people/one/git-commits", user=user[0], **YEAR)
    assert len(rows) == user[1] and [r["commit_time"] for r in rows] == sorted((r["commit_time"] for r in rows), reverse=True)
    assert len(ask("people/one/git-commits", user=user[0], limit=0, **YEAR)) == 1
    cut = ask("people/one/git-commits", user=user[0], first="1996-01-01", last="1996-12-31", today="1996-03-31")
    assert {r["id"] for r in cut} == {r["id"] for r in rows if r["commit_time"] < datetime.datetime(1996, 4, 1)}
    assert ask("people/one/git-commits", user="nobody", **YEAR) == []
    trend = ask("dashboard/token-trend", days=400, today="2024-01-20")
    assert len(trend) == 90 and sum(r["tokens"] for r in trend) == duck("SELECT sum(tokens) FROM activity WHERE signal_time >= TIMESTAMP '2023-10-23' AND signal_time < TIMESTAMP '2024-01-21'")[0][0]


def test_filters(ask):
    every = ask("admin/attribution/commits", limit=500, **YEAR)
    some = ask("admin/attribution/commits", limit=500, tool="claude", tier="B", **YEAR)
    assert some and {r["id"] for r in some} == {r["id"] for r in every if r["tool"] == "claude" and r["tier"] == "B"}
    pivot = ask("admin/attribution/pivot", by="user_code,tool", **YEAR)
    assert sum(r["n"] for r in pivot) == sum(r["n"] for r in ask("admin/attribution/pivot", by=["model"], **YEAR))
    page = ask("ai-sessions", limit=5, **YEAR)
    more = ask("ai-sessions", limit=5, after=page[-1]["id"], **YEAR)
    assert page[-1]["id"] < more[0]["id"] and len(page) == 5
    kinds = {r["event_type"] for r in ask("ai-sessions/events", session=7)}
    assert {r["event_type"] for r in ask("ai-sessions/events", session=7, kind="TOKEN_DELTA")} == kinds & {"TOKEN_DELTA"}


def test_wrong_parameters(spark):
    for path, given, error in [
        ("people", {"user": "u7"}, TypeError), ("people/one", {}, ValueError), ("dashboard/ai-penetration", {"window": "1y"}, ValueError),
        ("admin/attribution/pivot", {"by": "colour"}, ValueError), ("people", {"first": "yesterday"}, ValueError), ("nowhere", {}, KeyError),
    ]:
        with pytest.raises(error):
            entrypoints.call(spark, SF, path, **given)
