"""Sub-agents of sub-agents against a plain recursion: three levels, several calls in one session, cycles, children without a call."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.operators import sequences

START = datetime(2026, 1, 1)


def plain(messages, links):
    parent = {c: p for c, p, _ in sorted(links, key=lambda x: -x[1])}  # of several parents the least
    own, kids = {}, {}
    for i, s, seq, agent in messages:
        own.setdefault(s, []).append((seq, i, agent))

    def root(s):
        seen = [s]
        while seen[-1] in parent:
            if parent[seen[-1]] in seen:
                return s
            seen.append(parent[seen[-1]])
        return seen[-1]

    for c, p, rank in links:
        if root(c) != c:
            kids.setdefault(p, []).append((rank, c))

    def spelled(s):
        children, out = [c for _, c in sorted(kids.get(s, []))], []
        for _, i, agent in sorted(own.get(s, [])):
            out.append(i)
            if agent and children:
                out += spelled(children.pop(0))
        return out + [i for c in children for i in spelled(c)]

    sessions = set(own) | set(parent) | set(parent.values())
    return {i: (s, n) for s in sessions if root(s) == s for n, i in enumerate(spelled(s), 1)}


def found(spark, messages, links):
    rows = spark.createDataFrame(messages, "id long, session_id long, seq long, agent boolean")
    out = sequences.spliced_forest(rows, spark.createDataFrame(links, "child long, parent long, rank long"), ["seq", "id"], F.col("agent"))
    return {r["id"]: (r["root"], r["place"]) for r in out.collect()}


def test_three_levels(spark):
    links = [(2, 1, 2), (3, 1, 1), (4, 2, 1), (5, 4, 1), (6, 4, 2), (7, 3, 9), (8, 99, 1)]
    messages = [(10 * s + k, s, k, k in (2, 3) and s != 3) for s in (1, 2, 3, 4, 5, 6, 7, 8) for k in range(1, 5)]
    got = found(spark, messages, links)
    assert got == plain(messages, links)
    assert [i for i, (r, _) in sorted(got.items(), key=lambda x: x[1][1]) if r == 1][:8] == [11, 12, 31, 32, 33, 34, 71, 72]


def test_cycles_are_roots(spark):
    links = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 1, 1), (5, 4, 1), (6, 6, 1), (7, 8, 1)]
    messages = [(10 * s + k, s, k, True) for s in range(1, 9) for k in range(3)]
    got = found(spark, messages, links)
    assert got == plain(messages, links)
    assert {got[i][0] for i in (10, 20, 30, 40, 60)} == {1, 2, 3, 4, 6} and got[70][0] == 8


def test_random_forests(spark):
    rng = random.Random(3)
    links = [(s, rng.choice([s - 1, s // 2, rng.randrange(1, s)]), rng.randrange(3)) for s in range(2, 60) if rng.random() < 0.9]
    messages = [(1000 * s + k, s, rng.randrange(9), rng.random() < 0.3) for s in range(1, 60) for k in range(rng.randrange(6))]
    assert found(spark, messages, links) == plain(messages, links)
    assert found(spark, [], []) == {} and len(found(spark, messages, [])) == len(messages)


def test_totals(spark):
    rows = [(i, 10 * i, START + timedelta(hours=i), START + timedelta(hours=2 * i)) for i in range(1, 8)]
    links = [(2, 1), (3, 2), (4, 3), (6, 7), (7, 6)]
    sessions = spark.createDataFrame(rows, "id long, tokens long, started timestamp_ntz, ended timestamp_ntz")
    out = sequences.tree_totals(sessions, spark.createDataFrame(links, "child long, parent long"), ["tokens"], "started", "ended")
    assert {r["root"]: (r["tokens"], r["started"], r["ended"], r["sessions"]) for r in out.collect()} == {
        1: (100, START + timedelta(hours=1), START + timedelta(hours=8), 4), **{i: (10 * i, START + timedelta(hours=i), START + timedelta(hours=2 * i), 1) for i in (5, 6, 7)}
    }


def test_a_tree_is_dealt_out_over_many_tasks(spark):
    """Two trees and rows without a session in seven ranges: the same places as in one."""
    rows = [(i, None if i % 50 == 0 else 1 + i % 40, i // 40, "tool" if i % 3 == 0 else "user") for i in range(2_000)]
    pairs = [(c, c // 2 if c % 2 == 0 else max(2, c - 1) // 2 * 2 - 1, c) for c in range(3, 41)]

    def places(session):
        found = sequences.spliced_forest(session.createDataFrame(rows, "id long, session_id long, seq long, role string"), session.createDataFrame(pairs, "child long, parent long, rank long"), ["seq", "id"], F.col("role") == "tool")
        assert "_part" in next(x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "Window" in x and "_path" in x)
        return sorted((tuple(r) for r in found.select("id", "session_id", "root", "place").collect()), key=repr)

    one, many = spark.newSession(), spark.newSession()
    one.conf.set("spark.sql.shuffle.partitions", "1")
    many.conf.set("spark.sql.shuffle.partitions", "7")
    many.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = places(many)
    assert found == places(one)
    for root in {r[2] for r in found}:
        own = sorted(r[3] for r in found if r[2] == root)
        assert own == [*range(1, len(own) + 1)]
