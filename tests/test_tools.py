"""Tools' SQLite stores: what reaches SQLite, and the joins, on small files of the tools' shapes."""

import base64
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains, StringStartsWith

from pulsegrid.sources import keyvalue, tools

SID = "00000000-0000-0000-0000-00000000000{}"


def store(path, **tables):
    with sqlite3.connect(path) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
            if rows:
                db.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    return str(path)


@pytest.fixture
def bubbles(tmp_path):
    rows = [(f"bubbleId:{SID.format(i % 3)}:{i}", json.dumps({"createdAt": f"2026-01-01T00:00:{i:02}.000Z"} if i % 5 else {})) for i in range(40)]
    return store(tmp_path / "state.db", cursorDiskKV=("key TEXT UNIQUE, value BLOB", [("aaa", "{}"), *rows, ("bubbleIe", "{}"), ("zzz", None)]))


def reader(path, size):
    return keyvalue.KeyValueStore({"path": path, "table": "cursorDiskKV", "rows_per_partition": str(size), "pushdown": "true"}).reader(None)


def test_comparisons_reach_sqlite(bubbles):
    found = reader(bubbles, 10)
    left = list(found.pushFilters([GreaterThan(("row_id",), 5), StringStartsWith(("key",), "bubbleId:"), StringContains(("key",), "x"), EqualTo(("file",), "f"), In(("row_id",), (6, 7, 30)), IsNotNull(("key",)), LessThanOrEqual(("value",), "~")]))
    assert [type(f) for f in left] == [StringContains, EqualTo]
    parts = found.partitions()
    assert [(p.low, p.high) for p in parts] == [(5, 15), (15, 25), (25, 30)]
    statement, values = found.statement(parts[0])
    assert statement == 'SELECT rowid, key, CAST(value AS TEXT) FROM "cursorDiskKV" WHERE rowid > ? AND key >= ? AND key < ? AND rowid IN (?, ?, ?) AND key IS NOT NULL AND value <= ? AND rowid > ? AND rowid <= ?'
    assert values == [5, "bubbleId:", "bubbleId;", 6, 7, 30, "~", 5, 15]
    assert [row[1] for part in parts for row in found.read(part)] == [6, 7, 30]


def test_a_key_range_uses_the_index(bubbles):
    found = reader(bubbles, 1_000)
    list(found.pushFilters([StringStartsWith(("key",), "bubbleId:")]))
    with sqlite3.connect(bubbles) as db:
        plan = " ".join(str(r) for r in db.execute(f"EXPLAIN QUERY PLAN SELECT key FROM cursorDiskKV{found.where}", found.where.values))
    assert "SEARCH" in plan and "INDEX" in plan


def test_spark_pushes_and_splits(spark, bubbles):
    tools.register(spark)
    rows = spark.read.format("sqlite_kv").option("pushdown", "true").option("path", bubbles).option("table", "cursorDiskKV").option("rows_per_partition", 10).load()
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 43
    some = rows.where((F.col("row_id") > 35) & F.col("key").startswith("bubbleId:"))
    assert sorted(r["row_id"] for r in some.collect()) == [36, 37, 38, 39, 40, 41]
    assert some.rdd.getNumPartitions() == 1


def test_bubble_sessions(spark, bubbles):
    tools.register(spark)
    found = {r["session_id"]: r["last_at"] for r in tools.bubble_sessions(spark, bubbles, "2026-01-01T00:00:37.000Z").collect()}
    assert found == {SID.format(2): "2026-01-01T00:00:38.000Z", SID.format(0): "2026-01-01T00:00:39.000Z"}
    after = tools.bubbles_after(spark, bubbles, 39).orderBy("row_id").collect()
    assert [(r["row_id"], r["session_id"], r["created_at"]) for r in after] == [(40, SID.format(2), "2026-01-01T00:00:38.000Z"), (41, SID.format(0), "2026-01-01T00:00:39.000Z")]


def test_counted_sessions(spark, tmp_path):
    sessions = [("a", "cli", "m", "t", 5, 6, 1, 100.0, None), ("b", "cli", None, None, 0, 0, 0, 100.5, 150.0), ("c", "x", "m", "", 1, 1, 0, 10.0, 20.0), ("d", "x", "m", "", 1, 1, 0, 200.0, 0.0)]
    messages = [(str(i), "a", role, "hi", None, 110.0 + i) for i, role in enumerate(["user", "assistant", "tool", "user"])] + [("9", "c", "user", "old", None, 15.0)]
    path = store(tmp_path / "h.db", sessions=("id, source, model, title, input_tokens, output_tokens, tool_call_count, started_at REAL, ended_at REAL", sessions), messages=("id, session_id, role, content, tool_name, timestamp REAL", messages))
    tools.register(spark)
    found = {r["session_id"]: (r["user_messages"], r["assistant_messages"], r["last_activity"]) for r in tools.counted_sessions(spark, path, 100.0).collect()}
    at = lambda s: datetime(1970, 1, 1, 0, s // 60, s % 60)
    assert found == {"a": (2, 1, at(113)), "b": (0, 0, at(150))}  # d: an end of 0 counts as it stands, so it is too old
    last = tools.last_messages(spark, path, 2).orderBy("session_id", "place").collect()
    assert [(r["session_id"], r["id"], r["place"]) for r in last] == [("a", "2", 1), ("a", "3", 2), ("c", "9", 1)]


def test_live_sessions(spark, tmp_path):
    def data(role, **more):
        return json.dumps({"role": role, **more})

    tokens = {"input": 1, "output": 2, "reasoning": 4, "cache": {"read": 10, "write": 100}}
    sessions = [("s", "/d", "t", None, 3, 4, 1_000, 5_000, None), ("old", "/d", "t", "m", 0, 0, 1_000, 1_500, 0), ("gone", "/d", "t", "m", 0, 0, 9_000, 9_000, 9_500), ("new", None, None, "m2", None, None, 7_000, None, 0)]
    messages = [("m1", "s", 1_000, data("user")), ("m2", "s", 2_000, data("assistant", modelID="big", tokens=tokens, time={"completed": 2_500})), ("m3", "s", 0, data("assistant", time={"created": 3_000})), ("m4", "s", 4_000, "no json")]
    parts = [("p2", "m1", "s", '{"type":"text","text":"b"}'), ("p1", "m1", "s", '{"type":"text","text":"a"}'), ("p3", "m2", "s", '{"type":"tool"}')]
    path = store(tmp_path / "o.db", session=("id, directory, title, model, tokens_input, tokens_output, time_created, time_updated, time_archived", sessions), message=("id, session_id, time_created, data", messages), part=("id, message_id, session_id, data", parts))
    tools.register(spark)
    found = {r["session_id"]: r for r in tools.live_sessions(spark, path, 2_000).collect()}
    assert set(found) == {"s", "new"}
    assert (found["s"]["model"], found["s"]["user_messages"], found["s"]["assistant_messages"], found["s"]["tokens_input"]) == ("big", 1, 2, 3)
    assert (found["new"]["model"], found["new"]["directory"], found["new"]["last_activity"]) == ("m2", "", datetime(1970, 1, 1, 0, 0, 7))
    rows = {r["id"]: r for r in tools.messages_with_parts(spark, path).collect()}
    assert [p["text"] for p in json.loads(rows["m1"]["parts"])] == ["a", "b"] and set(rows) == {"m1", "m2"}
    assert (rows["m2"]["input_tokens"], rows["m2"]["output_tokens"], rows["m2"]["at"]) == (111, 6, datetime(1970, 1, 1, 0, 0, 2))


def packed(number, value):
    """A field in wire format."""

    def number_(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return number_(number << 3) + number_(value)
    value = value.encode() if isinstance(value, str) else value
    return number_(number << 3 | 2) + number_(len(value)) + value


def entry(name, *fields):
    return packed(1, packed(1, name) + packed(2, packed(1, base64.b64encode(b"".join(fields)))))


def test_summaries(spark):
    time = lambda s, n=0: packed(1, s) + packed(2, n)
    blob = entry("c1", packed(1, "Title é"), packed(3, time(100)), packed(7, time(50, 1_500)), packed(9, packed(1, "file:///home/u/my%20dir")), packed(10, time(200)))
    blob += entry("c2", packed(4, "other"), packed(99, 1 << 40), packed(3, time(0))) + packed(2, "ignored") + entry("", packed(1, "no id")) + packed(1, b"\x0a\x05abc")
    want = [("c1", "Title é", "/home/u/my dir", datetime(1970, 1, 1, 0, 0, 50, 1), datetime(1970, 1, 1, 0, 3, 20)), ("other", "", "", None, None)]
    rows = [(blob,), (base64.b64encode(blob),), (None,), (b"",), (blob[:-3],), (b"\xff" * 40,)]
    found = [tuple(r) for r in tools.conversation_summaries(spark.createDataFrame(rows, "value binary"), "value").collect()]
    assert sorted(found, key=repr) == sorted(want * 3, key=repr)


def test_wire():
    data = packed(1, 300) + packed(2, b"xy") + bytes([3 << 3 | 1]) + b"12345678" + bytes([4 << 3 | 5]) + b"1234" + packed(5, (1 << 64) - 1)
    assert list(tools.wire(data)) == [(1, 300), (2, b"xy"), (3, b"12345678"), (4, b"1234"), (5, (1 << 64) - 1)]
    for i in range(len(data)):
        assert list(tools.wire(data[:i])) == list(tools.wire(data))[: len(list(tools.wire(data[:i])))]
    assert list(tools.wire(b"\x80" * 11)) == [] and list(tools.wire(bytes([1 << 3 | 3]))) == []
