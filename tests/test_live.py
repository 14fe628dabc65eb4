"""Live folds equal the fold over the table, whatever the micro-batches bring, over a restart, and forget what they may."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming import live

START = datetime(2026, 1, 1)
SCHEMA = "id long, k string, at timestamp_ntz"
USER = "if(id % 7 <> 0, concat('u', id % 3), null) AS user"
FOLDS = {
    "claims": (live.Claims(600), ["id"]),
    "throttle": (live.Throttle(300, 1_000), ["id"]),
    "debounce": (live.Debounce(), [USER]),
    "unchanged": (live.Unchanged(200), ["id", "id % 3 AS print", "id % 4 <> 0 AS idle"]),
}


def columns(payload):
    return [F.expr(x) for x in payload]


def plain(rows, name):
    """Every fold once more, as loops over each key's rows."""
    found, keys = [], sorted({k for _, k, _ in rows}, key=repr)
    for key in keys:
        own = sorted((at, i) for i, k, at in rows if k == key)
        if name == "claims":
            last = None
            for at, i in own:
                if last is None or at >= last + timedelta(seconds=600):
                    found.append((key, at, i))
                    last = at
        elif name == "throttle":
            last, held = None, 0
            for at, i in own:
                if last is not None and at < last + timedelta(seconds=300):
                    held += 1
                    continue
                forgotten = last is not None and at >= last + timedelta(seconds=1_000)
                found.append((key, at, i, 0 if forgotten else held))
                last, held = at, 0
        elif name == "unchanged":
            sent = None
            for at, i in own:
                if sent is None or i % 4 == 0 or i % 3 != sent[1] or at >= sent[0] + timedelta(seconds=200):
                    found.append((key, at, i))
                    sent = (at, i % 3)
        else:
            marks = []
            for at, i in [*own, (datetime.max, None)]:
                if marks:
                    due = min(marks[-1][0] + timedelta(seconds=15), marks[0][0] + timedelta(seconds=60))
                    if at >= due:
                        users = {f"u{j % 3}" if j % 7 else None for _, j in marks}
                        found += [(key, due, len(marks), u) for u in ([None] if None in users else sorted(users))]
                        marks = []
                marks.append((at, i))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, f"k{rng.randrange(4)}", START + timedelta(milliseconds=rng.choice([1, 500, 1000]) * rng.randrange(5_000))) for i in range(500)]
    return out + [(1_000, "k0", out[0][2]), (1_001, None, START), (1_002, None, START)]


@pytest.mark.parametrize("name", FOLDS)
def test_over_a_table(spark, rows, name):
    fold, payload = FOLDS[name]
    found = live.folded(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", "at", columns(payload), fold)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, name)
    assert live.folded(spark.createDataFrame([], SCHEMA), "k", "at", columns(payload), fold).count() == 0


@pytest.mark.parametrize("name", FOLDS)
def test_live_over_shuffled_batches_and_a_restart(spark, rows, name, tmp_path):
    """Six files in any order, the stream stopped after three; a last row lets the watermark pass the others."""
    fold, payload = FOLDS[name]
    order = list(rows)
    random.Random(name).shuffle(order)

    def add(part, number):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"new{number}"))
        for file in (tmp_path / f"new{number}").glob("*.parquet"):
            shutil.move(file, tmp_path / "in" / f"{number}.parquet")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = live.live(stream, "k", "at", columns(payload), fold, late="2 hours")
        job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, job.recentProgress) if p["stateOperators"]]

    (tmp_path / "in").mkdir()
    for i in range(3):
        add(order[i::6], i)
    held = run()
    for i in range(3, 6):
        add(order[i::6], i)
    add([(-1, "end", START + timedelta(days=3))], 6)
    held += run()
    found = spark.read.parquet(str(tmp_path / "out")).where("key is null or key <> 'end'")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, name)
    assert max(held) > 400 and held[-1] <= 4  # of all keys only the last row's is known


def test_replays_claim_anew_after_they_are_forgotten(spark):
    rows = [(i, "n", START + timedelta(seconds=s)) for i, s in enumerate([0, 1, 599, 600, 1_199, 1_201])]
    found = live.folded(spark.createDataFrame(rows, SCHEMA), "k", "at", columns(["id"]), live.Claims(600))
    assert sorted(r["id"] for r in found.collect()) == [0, 3, 5]


def test_a_full_build_is_not_made_smaller(spark):
    rows = [(1, "d", START), (7, "d", START + timedelta(seconds=5)), (2, "d", START + timedelta(seconds=6)), (3, "d", START + timedelta(seconds=90))]
    found = live.folded(spark.createDataFrame(rows, SCHEMA), "k", "at", columns([USER]), live.Debounce())
    assert sorted((r["at"], r["marks"], r["user"]) for r in found.collect()) == [(START + timedelta(seconds=21), 3, None), (START + timedelta(seconds=105), 1, "u0")]


@pytest.mark.parametrize("name", ["unchanged", "debounce"])
def test_a_key_with_very_many_rows_is_few_entries_of_state(spark, name, tmp_path):
    """Files in order of time, so that each watermark passes a part of what waits; a row is no entry of its own."""
    fold, payload = FOLDS[name]
    rng = random.Random(3)
    rows = sorted(((i, "k", START + timedelta(milliseconds=rng.randrange(3_000_000))) for i in range(6_000)), key=lambda row: row[2])
    for number, part in enumerate([rows[:2_000], rows[2_000:4_000], rows[4_000:], [(-1, "end", START + timedelta(days=3))]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"new{number}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for file in (tmp_path / f"new{number}").glob("*.parquet"):
            shutil.move(file, tmp_path / "in" / f"{number}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.live(stream, "k", "at", columns(payload), fold, late="5 minutes")
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, job.recentProgress) if p["stateOperators"]]
    found = spark.read.parquet(str(tmp_path / "out")).where("key <> 'end'")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, name)
    assert 10 < max(held) < 500


@pytest.mark.parametrize("name", ["claims", "throttle", "debounce"])
def test_few_rows_of_a_key_wait_in_its_value(spark, name, tmp_path):
    """Files in order of time, rows that come twice and a null key; watermarks leave some of the few rows waiting. One key has more."""
    fold, payload = FOLDS[name]
    rng = random.Random(4)
    keys = [None, *(f"k{n}" for n in range(29))]
    rows = [(i, keys[i % 30], START + timedelta(milliseconds=rng.randrange(3_000_000))) for i in range(360)]
    rows += rows[:60] + [(1_000 + i, "k0", START + timedelta(seconds=30 * i)) for i in range(90)]
    rows.sort(key=lambda row: (row[2], row[0]))
    (tmp_path / "in").mkdir()
    for number, part in enumerate([rows[:170], rows[170:340], rows[340:], [(-1, "end", START + timedelta(days=3))]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"new{number}"))
        for file in (tmp_path / f"new{number}").glob("*.parquet"):
            shutil.move(file, tmp_path / "in" / f"{number}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.live(stream, "k", "at", columns(payload), fold, late="20 minutes")
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, job.recentProgress) if p["stateOperators"]]
    found = spark.read.parquet(str(tmp_path / "out")).where("key is null or key <> 'end'")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, name)
    assert max(held) < 150  # 31 values, and entries of the one key with more than a few rows


class Store:
    """A state store of one key in memory, which counts its calls."""

    def __init__(self):
        self.value, self.entries, self.timers, self.calls = None, {}, set(), []

    def __getattr__(self, name):
        does = {
            "getValueState": lambda *_: Value(self), "getMapState": lambda *_: self,
            "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
            "updateValue": self.entries.__setitem__, "getValue": self.entries.__getitem__, "removeKey": self.entries.__delitem__,
            "keys": lambda: list(self.entries), "iterator": lambda: list(self.entries.items()), "clear": self.entries.clear,
        }
        if name not in does:
            raise AttributeError(name)
        self.calls.append(name)
        return does[name]


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        return self.store.value

    def update(self, value):
        self.store.value = value

    def clear(self):
        self.store.value = None


@pytest.mark.parametrize("at_once", [live.RUN, 10])
def test_waiting_entries_are_read_and_dropped_at_once(spark, monkeypatch, at_once):
    """Rows of one key, some twice, in three batches; a watermark in the middle of them and one behind; also where too many wait for one call."""

    class Clock:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at // 1000

    if hasattr(live, "AT_ONCE"):
        monkeypatch.setattr(live, "AT_ONCE", at_once)
    rng, store = random.Random(5), Store()
    rows = [(rng.randrange(4_000) * live.SECOND, i) for i in range(120)]
    rows += rows[:30]
    fold = live.InOrder(live.Throttle(300, 1_000))
    fold.init(store)
    found = []
    for batch in (rows[:67], rows[67:77], rows[77:]):
        fold.handleInputRows(("k",), iter([("k", at, i, None) for at, i in batch]), None)
    for now in (2_000 * live.SECOND, 9_000 * live.SECOND):
        store.calls.clear()
        store.timers.clear()
        found += [tuple(x) for x in fold.handleExpiredTimer(("k",), Clock(now), None)]
    assert store.value is None and not store.entries
    as_times = [(i, "k", START + timedelta(microseconds=at)) for at, i in rows]
    assert sorted(((k, START + timedelta(microseconds=at), *rest) for k, at, *rest in found), key=repr) == plain(as_times, "throttle")
    if at_once == live.RUN:
        assert store.calls.count("iterator") == store.calls.count("clear") == 1
        assert not {"getValue", "removeKey"} & set(store.calls)
