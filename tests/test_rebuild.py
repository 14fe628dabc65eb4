"""Incremental builds: late rows rebuild their pairs and no others, leases keep two builders apart."""

import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming.rebuild import PAIR, Builds

NOW = datetime(2026, 1, 10)
ROWS = "at timestamp_ntz, user_code string, tokens long"


@pytest.fixture
def builds(spark, tmp_path):
    return Builds(spark, str(tmp_path), "tokens long")


def rows(spark, *some):
    return spark.createDataFrame([(datetime(2026, 1, d), u, n) for d, u, n in some], ROWS)


def pairs(df):
    return df.select(F.to_date("at").alias("work_date"), "user_code").distinct()


def summed(df):
    day = df.withColumn("work_date", F.to_date("at"))
    return lambda some: day.join(some, PAIR, "left_semi").groupBy(*PAIR).agg(F.sum("tokens").alias("tokens"))


def table(builds):
    return {(r["work_date"].day, r["user_code"]): (r["tokens"], r["version"]) for r in builds.results().collect()}


def test_late_rows_rebuild_their_pairs_only(spark, builds):
    first = rows(spark, (1, "a", 5), (1, "b", 6), (2, "a", 7), (2, "a", 1))
    assert builds.mark(pairs(first), "events", 0) and not builds.mark(pairs(first), "events", 0)
    assert builds.run("x", lambda: NOW, summed(first), most=2) == 2
    before = table(builds)
    assert {k: v[0] for k, v in before.items()} == {(1, "a"): 5, (1, "b"): 6, (2, "a"): 8}
    late = rows(spark, (1, "b", 100), (3, "c", 9))
    builds.mark(pairs(late), "events", 1)
    assert {tuple(r) for r in builds.due(NOW).collect()} == {(date(2026, 1, 1), "b"), (date(2026, 1, 3), "c")}
    assert builds.run("x", lambda: NOW, summed(first.union(late))) == 1
    after = table(builds)
    assert {k: v[0] for k, v in after.items()} == {(1, "a"): 5, (1, "b"): 106, (2, "a"): 8, (3, "c"): 9}
    assert {k for k in after if after[k] != before.get(k)} == {(1, "b"), (3, "c")}
    assert builds.run("x", lambda: NOW, summed(first)) == 0


def test_rows_that_are_gone(spark, builds):
    first = rows(spark, (1, "a", 5), (2, "a", 5))
    builds.mark(pairs(first), "events", 0)
    builds.run("x", lambda: NOW, summed(first))
    builds.mark(pairs(first.where("day(at) = 1")), "deletes", 0)
    builds.run("x", lambda: NOW, summed(first.where("day(at) = 2")))
    assert set(table(builds)) == {(2, "a")}


def test_leases(spark, builds):
    """A lease keeps others off until it runs out; who lost it keeps nothing of what it built; a mark in between is due after."""
    some = rows(spark, (1, "a", 5))
    builds.mark(pairs(some), "events", 0)
    slow = builds.lease("slow", NOW, seconds=60)
    assert slow.count() == 1 and builds.lease("quick", NOW + timedelta(seconds=59)) is None
    taken = builds.lease("quick", NOW + timedelta(seconds=60))
    assert taken.count() == 1
    builds.mark(pairs(some), "events", 1)
    assert not builds.finish("slow", slow, summed(rows(spark, (1, "a", 1)))(slow))
    assert builds.lease("third", NOW + timedelta(seconds=61)) is None
    assert builds.finish("quick", taken, summed(some)(taken)) and table(builds)[1, "a"][0] == 5
    assert builds.lease("third", NOW + timedelta(seconds=61)).count() == 1
    assert not builds.finish("quick", taken, summed(some)(taken))


def test_two_builders_never_build_one_pair(spark, builds):
    many = rows(spark, *[(d, u, d) for d in range(1, 7) for u in "ab"])
    builds.mark(pairs(many), "events", 0)
    done, errors = {"x": [], "y": []}, []

    def build(name):
        def work(some):
            done[name] += [tuple(r) for r in some.collect()]
            return summed(many)(some)

        try:
            builds.run(name, lambda: NOW, work, most=4)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=build, args=(n,)) for n in done]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert not set(done["x"]) & set(done["y"]) and len(done["x"] + done["y"]) == 12
    assert {k: v[0] for k, v in table(builds).items()} == {(d, u): d for d in range(1, 7) for u in "ab"}
