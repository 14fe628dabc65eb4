"""Reports within a budget that follows refusals, against a plain version of the choice."""

import random
from datetime import datetime, timedelta

from pulsegrid.streaming import budget
from pulsegrid.streaming.budget import ENVELOPE, LEAST

START = datetime(2026, 1, 1)
SCHEMA = "client string, session string, idle boolean, last_activity timestamp_ntz, base long, seq long, size long"


def plain(rows, most):
    """The rows that go, session by session."""
    out = set()
    for client in {r[0] for r in rows}:
        sessions = {}
        for r in rows:
            if r[0] == client:
                sessions.setdefault((r[2], -(r[3] - START).total_seconds(), r[1]), []).append(r)
        used, placed = ENVELOPE, 0
        for _, own in sorted(sessions.items()):
            own.sort(key=lambda r: r[5] or 0)
            room, sizes = most - used - own[0][4], []
            if placed and room < 0:
                continue
            for r in own:
                if r[6] is None or (not placed and not sizes) or r[6] <= room - sum(sizes):
                    sizes.append(r[6] or 0)
                else:
                    break
            if sizes:
                placed, used = placed + 1, used + own[0][4] + sum(sizes)
                out |= {(client, r[1], r[5]) for r in own[: len(sizes)]}
    return out


def backlog(rng, clients=3):
    out = []
    for c in range(clients):
        for s in range(rng.randint(1, 8)):
            head = (f"c{c}", f"s{s}", rng.random() < 0.5, START + timedelta(minutes=rng.randrange(5)), rng.randint(100, 3_000))
            out += [(*head, k, rng.choice([500, 5_000, 20_000])) for k in range(rng.randint(0, 6))] or [(*head, None, None)]
    return out


def test_next_report(spark):
    rng = random.Random(2)
    for most in (5_000, 20_000, 60_000):
        rows = backlog(rng)
        budgets = spark.createDataFrame([(f"c{i}", most) for i in range(3)], "client string, budget long")
        found = budget.next_report(spark.createDataFrame(rows, SCHEMA).repartition(2), budgets)
        assert {(r["client"], r["session"], r["seq"]) for r in found.where("sent").collect()} == plain(rows, most)
        sizes = {r["client"]: (r["used"], r["sessions"]) for r in budget.report_sizes(found).collect()}
        assert set(sizes) == {r[0] for r in rows}
        assert all(used <= most or sessions == 1 for used, sessions in sizes.values())
    assert budget.next_report(spark.createDataFrame([], SCHEMA), budgets).count() == 0


def test_held_back(spark):
    rows = [("c", "large", False, START, 10, 0, 99_000), ("c", "small", True, START, 10, 0, 10)]
    budgets = spark.createDataFrame([("c", 50_000)], "client string, budget long")
    held = spark.createDataFrame([("c", "large", START + budget.HELD_BACK)], "client string, session string, until timestamp_ntz")
    sent = lambda now: {r["session"] for r in budget.next_report(spark.createDataFrame(rows, SCHEMA), budgets, held, now).where("sent").collect()}
    assert sent(START) == {"small"} and sent(START + budget.HELD_BACK) == {"large"}


def test_the_budget_follows_refusals():
    own = budget.Budget(1 << 20)
    own.refused(900_000)
    assert own.current == 450_000
    own.refused(2_000_000)
    assert own.current == 225_000
    for _ in range(20):
        own.refused(0)
    assert own.current == LEAST
    for _ in range(9):
        own.taken(LEAST)
    own.taken(LEAST // 3)
    assert (own.current, own.streak) == (LEAST, 9)
    own.taken(LEAST)
    assert own.current == 2 * LEAST
    own.current = 600_000
    for _ in range(10):
        own.taken(600_000)
    assert own.current == 1 << 20 and own.streak == 0


def test_a_backlog_goes_out_below_what_the_server_takes():
    """Reports shrink until the server takes them, grow again, and all but what no report can hold gets through."""
    rng, limit, own, sent, held = random.Random(5), 150_000, budget.Budget(1 << 20), [], set()
    left = [(f"s{i}", rng.choice([1_000, 30_000, 60_000, 200_000 if i % 9 == 0 else 2_000])) for i in range(400)]
    todo, refused = list(left), 0
    for _ in range(2_000):
        room, go = budget.Room(own.current), []
        for item in todo:
            if item[0] not in held and room.fits(item[0], 10, item[1]):
                go.append(item)
        if not go:
            break
        if room.used > limit:
            refused += 1
            if len(go) == 1:
                held.add(go[0][0])
            own.refused(room.used)
        else:
            own.taken(room.used)
            sent += go
            todo = [x for x in todo if x not in go]
    assert sorted(sent + [x for x in left if x[0] in held]) == sorted(left)
    assert all(size > limit - ENVELOPE - 10 for name, size in left if name in held) and refused < 200
