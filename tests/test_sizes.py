"""Tasks and partitions of a shuffle become more with the tables, however few the session begins with."""

from pulsegrid import shared
from pulsegrid.plans import MODULES
from pulsegrid.plans.bindings import Lake

SF = "/root/testdata/sf0.001"


def test_partitions_follow_the_size_of_a_table(spark, monkeypatch):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "2")
    Lake(other, SF).source("lineitem")
    assert other.conf.get(shared.PARTITIONS, None) is None  # small tables change nothing
    monkeypatch.setattr(shared, "SHARE", 1_000)
    rows = Lake(other, SF).source("lineitem")
    assert int(other.conf.get(shared.PARTITIONS)) > 50
    assert int(other.conf.get(shared.SPLITS)) <= shared.SPLIT and int(other.conf.get(shared.LEAST)) <= shared.SPLIT
    other.conf.set(shared.LEAST, "1b")
    other.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    assert rows.repartition("l_orderkey").rdd.getNumPartitions() > 50
    other.conf.unset(shared.LEAST)
    for name, query in ((n, m.QUERIES[n]) for m in MODULES for n in ("win_14", "agg_c2", "agg_d3") if n in m.QUERIES):
        assert sorted(map(tuple, query(other, SF).collect())) == sorted(map(tuple, query(spark, SF).collect())), name


def test_finer_settings_stay(spark, monkeypatch):
    other = spark.newSession()
    monkeypatch.setattr(shared, "SHARE", 1_000)
    for name, value in ((shared.PARTITIONS, "5000"), (shared.SPLITS, "1m"), (shared.LEAST, "2m")):
        other.conf.set(name, value)
    Lake(other, SF).source("lineitem")
    assert [other.conf.get(name) for name in (shared.PARTITIONS, shared.SPLITS, shared.LEAST)] == ["5000", "1m", "2m"]


def test_marks_of_a_pair_are_dealt_out_once(spark):
    """The window over a session's events and the pairs of it share one exchange."""
    from pulsegrid.operators import attribution

    pairs = spark.sql("select 1L id, 2L s_id, timestamp_ntz'2026-01-01 10:00:00' commit_time, 'm' s_model")
    events = spark.sql("select 2L session_id, timestamp_ntz'2026-01-01 09:50:00' event_time")
    found = attribution.with_signals(pairs, events, 30)
    assert "hashpartitioning(pair" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["signals"], r["last_signal"].minute) for r in found.collect()] == [(1, 50)]
