"""Rules that have fixed cases, and ordered folds against plain versions."""

import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import content, text
from pulsegrid.operators import extensions, hits, joins, sequences, stats
from pulsegrid.sources import tail
from pulsegrid.streaming import sinks, states

START = datetime(2026, 1, 1)


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scores(spark):
    def raw(cap, out, done, revert, commits, challenge, leverage, dependent):
        return stats.raw_score(*[F.lit(x).cast("double") for x in (cap, out, done, revert, commits, challenge, leverage, dependent)])

    found = values(spark, raw(5, 1, 1, 0, 5, 1, 1, 0), raw(3, 0, 0, None, 0, 0, None, None), raw(0, 0, 1, 1, 2, 0, None, None), raw(0, 0, 1, None, 0, 0, None, None))
    assert found == pytest.approx([100, 27.5, found[3], found[3]])
    near = [stats.shrunk(F.lit(80.0), F.lit(m).cast("double"), F.lit(n)) for m, n in ((60, 10), (60, 30), (float("nan"), 10))]
    assert values(spark, *near) == pytest.approx([70, 75, 80])
    assert values(spark, *[stats.grade(F.lit(x)) for x in (85.0, 84.99, 70.0, 69.99, 55.0, 54.99, 40.0, 39.99)]) == list("SAABBCCD")
    assert values(spark, *[stats.confidence(F.lit(n)) for n in (10, 19, 20)]) == ["low", "low", "normal"]


def test_value_ranks(spark):
    rng = random.Random(2)
    xs = [rng.randint(0, 30) for _ in range(400)]
    found = {r.x: r.pct for r in stats.value_ranks(spark.createDataFrame([(x,) for x in [*xs, None]], "x int"), "x", "pct").collect()}
    assert found == pytest.approx({x: 100 * sum(y <= x for y in xs) / len(xs) for x in set(xs)})


@pytest.mark.parametrize("body, kind, tool", [
    ("fix\n\nCo-Authored-By: Claude X <a@b>", "claude_coauthor", "claude"),
    ("🤖 Generated with [Claude Code](https://x)", "claude_code", "claude"),
    ("Claude-Session: https://x/1", "claude_code", "claude"),
    ("Co-Authored-By: Claude\nGenerated with Claude Code", "claude_code", "claude"),
    ("Co-Authored-By: OpenAI-Codex <a@b>", "codex", "codex"),
    ("co-authored-by: codex <a@b>", "codex", "codex"),
    ("Co-authored-by: Cursor Agent <a@b>", "cursor", "cursor"),
    ("Co-authored-by: GitHub-Copilot <a@b>", "copilot", "copilot"),
    ("Co-authored-by: aider (gpt) <a@b>", "aider", "aider"),
    (None, None, None), ("", None, None), ("about claude", None, None), ("Co-authored-by: 张三 <a@b>", None, None),
])
def test_trailers(spark, body, kind, tool):
    assert values(spark, text.trailer(F.lit(body).cast("string")), text.trailer(F.lit(body).cast("string"), "tool")) == [kind, tool]


def test_configured_trailers(spark):
    rules = text.trailer_rules('[{"kind":"bad","pattern":"(["},{"kind":"surf","pattern":"co-authored-by:\\\\s*surf","target_type":"surf"},{"kind":"bot","pattern":"foo-bot"}]')
    assert len(rules) == len(text.TRAILERS) + 2 and text.trailer_rules("no json") == text.TRAILERS
    both = F.lit("Co-Authored-By: Claude\nCo-Authored-By: Surf")
    assert values(spark, text.trailer(F.lit("co-authored-by: SURF"), "tool", rules), text.trailer(both, "kind", rules), text.trailer(F.lit("by Foo-Bot"), "kind", rules)) == ["surf", "claude_coauthor", "bot"]


def test_roots(spark):
    links = [(i + 1, i) for i in range(1_000)] + [(2001, 2002), (2002, 2003), (2003, 2001), (3001, 3002), (3002, 3001), (4001, 2001), (5, 4), (6001, 6001)]
    found = {r.child: r.root for r in joins.roots(spark.createDataFrame(links, "child long, parent long")).collect()}
    assert found == {i: 0 for i in range(1, 1_001)} | {n: n for n in (2001, 2002, 2003, 3001, 3002, 4001, 6001)}
    orphans = {r.child: r.root for r in joins.roots(spark.createDataFrame([(1, 2), (2, 9)], "child long, parent long"), promote_orphans=False).collect()}
    assert orphans == {1: 2}
    assert joins.roots(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_band(spark):
    rng = random.Random(4)
    points = [(i, f"u{rng.randint(0, 2)}", START + timedelta(minutes=rng.randint(0, 90_000))) for i in range(200)]
    spans = [(i, f"u{rng.randint(0, 2)}", s := START + timedelta(minutes=rng.randint(-500_000, 90_000)), s + timedelta(minutes=rng.choice([-5, 0, 30, 2_000, 80_000, 900_000]))) for i in range(60)]
    want = {(p[0], s[0]) for p in points for s in spans if p[1] == s[1] and s[2] <= p[2] <= s[3]}
    left = spark.createDataFrame(points, "id long, user string, at timestamp_ntz")
    right = spark.createDataFrame(spans, "s_id long, s_user string, a timestamp_ntz, b timestamp_ntz")
    found = joins.band(left, right, {"user": "s_user"}, "at", F.col("a"), F.col("b")).select("id", "s_id").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    semi = joins.band(left, right, {"user": "s_user"}, "at", F.col("a"), F.col("b"), "left_semi").collect()
    assert sorted(r.id for r in semi) == sorted({p for p, _ in want})


def signals(n, keys, seconds, seed):
    rng = random.Random(seed)
    return sorted((f"k{rng.randint(1, keys)}", START + timedelta(seconds=rng.randint(0, seconds)), i) for i in range(n))


def test_throttled_and_debounced(spark):
    rows = signals(300, 4, 4_000, 7)
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id long").repartition(3)
    passed, due = [], []
    for key in {r[0] for r in rows}:
        last, held = None, 0
        for _, at, i in sorted(r for r in rows if r[0] == key):
            if last is None or (at - last).total_seconds() >= 60:
                passed.append((key, at, i, held))
                last, held = at, 0
            else:
                held += 1
        times = sorted(at for k, at, _ in rows if k == key)
        while times:
            end = times[0] + timedelta(seconds=15)
            n = 0
            while n < len(times) and (n == 0 or times[n] < end):
                end = min(times[n] + timedelta(seconds=15), times[0] + timedelta(seconds=60))
                n += 1
            due.append((key, end, n))
            times = times[n:]
    assert sorted(map(tuple, states.throttled(df, "k", "at", 60).collect())) == sorted(passed)
    assert sorted(map(tuple, states.debounced(df, "k", "at").collect())) == sorted(due)


def test_replays(spark):
    rng = random.Random(8)
    rows = [(i, f"a{i % 2}", rng.randint(0, 3), at := START + timedelta(seconds=rng.randint(0, 5_000)), at + timedelta(seconds=rng.choice([0, -299, 300, 301, -900]))) for i in range(200)]
    claimed, want = {}, set()
    for i, agent, nonce, at, sent in sorted(rows, key=lambda r: (r[3], r[0])):
        if abs((at - sent).total_seconds()) <= 300 and ((agent, nonce) not in claimed or (at - claimed[agent, nonce]).total_seconds() >= 600):
            claimed[agent, nonce] = at
            want.add(i)
    df = spark.createDataFrame(rows, "id long, agent string, nonce int, at timestamp_ntz, sent timestamp_ntz")
    assert {r.id for r in states.first_claims(df, ["agent", "nonce"], "at", "id", "sent").collect()} == want


def test_skill_uses(spark):
    def used(*messages):
        rows = [(1, i, role, reads, runs) for i, (role, reads, runs) in enumerate(messages)]
        df = spark.createDataFrame(rows, "session_id long, seq int, role string, reads array<string>, executes boolean")
        return sorted((r.turn_seq, r.token) for r in sequences.skill_uses(df).collect())

    user = ("user", [], False)
    assert used(user, ("tool", ["/skills/a"], False)) == []
    assert used(user, ("tool", ["/skills/foo"], False), ("tool", ["/skills/bar"], False), ("tool", [], True)) == [(0, "/skills/bar")]
    assert used(user, ("tool", ["/skills/a"], False), ("tool", [], True), ("tool", ["/skills/b"], False), ("tool", [], True)) == [(0, "/skills/a"), (0, "/skills/b")]
    assert used(user, ("assistant", ["/skills/a"], True)) == [(0, "/skills/a")]
    assert used(user, ("tool", ["/skills/a"], False), user, ("tool", [], True)) == []


def test_contents(spark):
    parts = '[{"type":"system_context","text":"s"},{"type":"text","text":"hi"},{"type":"file_ref","path":"a.py","start_line":1,"end_line":3},{"type":"image","width":2,"height":3,"blob_id":7},{"type":"tool_call","tool_name":"Bash","arguments_json":"{}"}]'
    flat = "--- system ---\ns\nhi\na.py:1-3\n[image 2x3 blob_id=7]\n[tool_call Bash]\n{}"
    assert values(spark, content.flattened(F.lit(parts)), content.flattened(F.lit("bad")), content.flattened(F.lit(None).cast("string"))) == [flat, "", ""]
    kinds = [content.content_kind(F.lit(j).cast("string")) for j in (parts, '[{"type":"text","text":"x"}]', '[{"type":"system_context","text":"x"}]', None, "[]")]
    assert values(spark, *kinds) == ["multipart", "text_only", "system_only", "text_only", "text_only"]
    assert values(spark, content.audit_text(F.lit(parts), F.lit("raw"), F.lit(1), 5), content.audit_text(F.lit(parts), F.lit("raw"), F.lit(0), 5)) == [flat[:5] + "...[截断]", "raw"]
    assert values(spark, content.reason_line(F.lit("[A: x] one\ntwo [B:y] three"))) == ["one two three"]
    hits = '[{"token":"/a","kind":"command"},{"token":"/skills/x","kind":"nl_skill"}]'
    merged = content.merged_hits(F.lit(hits), F.array(F.lit("/A"), F.lit("/skills/Y"), F.lit("/skills/y")))
    assert values(spark, merged, *content.hit_counts(merged)) == ['[{"token":"/a","kind":"command"},{"token":"/skills/y","kind":"nl_skill"}]', 1, 1]
    assert values(spark, content.argument_path(F.lit('[tool_call Read] {"file_path":"/x/skills/Foo/SKILL.md"}')), content.skill_in_path(F.lit("C:\\x\\skills\\Foo\\SKILL.md")), content.skill_in_path(F.lit("a/b"))) == ["/x/skills/Foo/SKILL.md", "/skills/foo", None]
    paths = ['"\\345\\221\\230.txt"', '""a\\"b""', " x ", "a\\\\b", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(content.git_path("p")).collect()] == ["员.txt", 'a"b', "x", "a\\b", ""]
    df = spark.createDataFrame([("äöü" * 5,), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(content.cut_bytes(F.col("t"), 5)).collect()] == ["äö" + content.CUT_MARK, "abc", None]
    round_trip = df.select(content.unzipped(content.zipped(F.col("t").cast("binary"))).cast("string"), content.mime(F.unhex(F.lit("89504E470D0A1A0A00"))))
    assert [tuple(r) for r in round_trip.collect()] == [("äöü" * 5, "image/png"), ("abc", "image/png"), (None, "image/png")]
    assert values(spark, content.epoch_time(F.lit(1.5)), content.epoch_time(F.lit(1_700_000_000_123))) == [datetime(1970, 1, 1, 0, 0, 1, 500_000), datetime(2023, 11, 14, 22, 13, 20, 123_000)]


def test_tail(spark, tmp_path):
    file = tmp_path / "s.jsonl"
    file.write_bytes(b"one\r\n" + b"x" * 50 + b"\ntwo\nhalf")
    cursors = spark.createDataFrame([], tail.CURSOR)

    def step(cursors):
        files = sinks.stage(tail.listed(spark, str(tmp_path)), "files")
        lines = sinks.stage(tail.read(tail.due(files, cursors), most_bytes=20), "lines")
        return [r.value for r in lines.orderBy("offset").collect()], sinks.stage(tail.advanced(files, lines, cursors), "cursors")

    got, cursors = step(cursors)
    assert got == ["one", None, "two"]
    assert step(cursors)[0] == []
    file.write_bytes(file.read_bytes() + b" more\n")
    got, cursors = step(cursors)
    assert got == ["half more"]
    file.write_bytes(b"new\n")
    assert step(cursors)[0] == ["new"]


def test_updates_and_blobs(spark):
    stored = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, n int")
    found = sinks.updated_if_changed(stored, spark.createDataFrame([(1, 5), (2, 4)], "id int, n int"), "id", ["n"])
    assert sorted(map(tuple, found.collect())) == [(1, 5, False), (2, 4, True), (3, 7, False)]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, body string")
    blobs, links = sinks.content_addressed(rows, "id", "body")
    assert blobs.count() == 2 and links.count() == 3
    emptied = blobs.withColumn("content", F.when(F.col("content") == "a", F.col("content")))
    assert [r.content for r in sinks.content_addressed(rows, "id", "body", emptied)[0].collect()] == ["b"]


def test_back_fill_goes_on(spark, tmp_path):
    items = spark.createDataFrame([(f"2026-01-0{d}", n) for d in range(1, 6) for n in range(3)], "day string, n int")
    calls = []

    def build(df):
        calls.append(sorted(r.day for r in df.select("day").distinct().collect()))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df.groupBy("day").agg(F.sum("n").alias("n"))

    path = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        sinks.resumed(spark, items, "day", build, path, rounds=1, at_once=2)
    found = sinks.resumed(spark, items, "day", build, path, rounds=2, at_once=2)
    assert found.count() == 5 and {r.n for r in found.collect()} == {3}
    assert calls[0] == ["2026-01-01", "2026-01-02"] and ["2026-01-01", "2026-01-02"] not in calls[1:]


def test_entry_points_name_queries():
    from pulsegrid import entrypoints
    from pulsegrid.plans import MODULES

    assert {n for names in entrypoints.READS.values() for n in names} <= {n for m in MODULES for n in m.QUERIES}


def test_plugged_in_transforms(spark):
    df = spark.createDataFrame([("A", 5, -1, 7), ("b", 3_000_000_000, 600_000_000, None), ("c", 1, 1, 1)], "kind string, total long, delta long, before long")
    found = extensions.guarded(df, totals=["total"], deltas=["delta"], previous={"total": "before"}).orderBy("kind").collect()
    assert [(r.total, r.delta) for r in found] == [(5, 0), (0, 0), (1, 1)]
    routed = extensions.routed(df, "kind", {"a": lambda d: d.select("kind", F.lit(1).alias("x")), "B": lambda d: d.select("kind", F.lit(2).alias("x"))})
    assert sorted((r.kind, r.x) for r in routed.collect()) == [("A", 1), ("b", 2)]


def test_mock_judges(spark):
    assert [extensions.text_code(t) for t in ("", "a", "hello", "polygenelubricants")] == [0, 97, 99162322, -(1 << 31)]
    prompts = [f"prompt {i}" for i in range(60)]

    def plain(prompt, model):
        seed = zlib.crc32(f"{prompt}|{model}".encode())
        salt = abs(extensions.text_code(model)) % 3
        caps = [max(1, min(5, 1 + (seed >> s) % 5 + salt - 1)) for s in (11, 17, 23, 29, 31)]
        return (1 + seed % 5, ["completed"] * 3 + ["partial", "abandoned"], (seed >> 3) % 5, (["leverage"] * 4 + ["debugging"] * 2 + ["learning", "exploratory", "dependent", "dependent"])[(seed >> 7) % 10], caps)

    df = spark.createDataFrame([(p,) for p in prompts], "prompt string")
    for r in extensions.two_verdicts(df, "prompt", ("m1", "m2")).collect():
        (d1, names, o1, m1, c1), (d2, _, o2, m2, c2) = (plain(r.prompt, m) for m in ("m1", "m2"))
        assert r.difficulty == (d1 + d2 + 1) // 2 and (r.outcome, r.mode) == ((names[o2], m2) if d2 > d1 else (names[o1], m1))
        assert [r.cap_problem, r.cap_context, r.cap_debug, r.cap_tool, r.cap_self] == [(a + b + 1) // 2 for a, b in zip(c1, c2)]
        assert r.disagreement == (abs(d1 - d2) > 1 or names[o1] != names[o2] or m1 != m2)


def test_tool_names(spark):
    names = {"read_file_v2": "Read", "Write_To_File": "Write", "apply_patch": "Edit", "run_terminal_command_v2": "Bash", "exec": "Bash", "list_dir": "Glob", "ripgrep_raw_search": "Grep", "web_search": "WebSearch", "fetch": "WebFetch", "spawn_subagent": "Agent", "mcp__x": "Mcp__x", "": "", None: None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.normal_tool(F.col("n")).alias("to")).collect()
    assert {r.n: r.to for r in rows} == names
    does = {"Bash": True, " edit_file_v2 ": True, "run_terminal_command": True, "mcp": True, "Task": True, "Read": False, "view_file": False, "Grep": False, "mcp__a__b": False, "": False, None: False, "StrReplace": True, "multi_patch": True}
    rows = spark.createDataFrame([(n,) for n in does], "n string").select("n", text.executes(F.col("n")).alias("does")).collect()
    assert {r.n: r.does for r in rows} == does


@pytest.mark.parametrize("body, kind, want", [
    ("<skill>\n<name> Deploy </name>\n...", "codex", ("deploy", "skill")), ("  <skill><name>x</name>", "Codex ", ("x", "skill")), ("see <skill><name>x</name>", "codex", None), ("<skill><name>two words</name>", "codex", None), ("/plan it", "codex", None),
    ("/plan it", "claude", None), ("/Plan it", "cursor", ("/plan", "command")), (" /my-skill now", None, ("/my-skill", "skill")), ("/usage", "", ("/usage", "noise")), ("go /plan", "cursor", None), ("<skill><name>x</name>", "cursor", None), (None, "cursor", None),
])
def test_invocations(spark, body, kind, want):
    found = values(spark, text.invocation(F.lit(body).cast("string"), F.lit(kind).cast("string")))[0]
    assert (tuple(found) if found else None) == want


def test_saturating_add(spark):
    top = (1 << 63) - 1
    pairs = [(1, 2, 3), (top, 1, top), (-top, -top, -top - 1), (top, -top, 0), (-1, -top - 1, -top - 1), (None, 1, None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a long, b long").select(text.saturating_add(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [s for _, _, s in pairs]


def test_message_counts(spark):
    rows = [(0, 5, 5), (5, 0, 0), (7, 5, 7), (5, 205, 5), (5, 206, 206), (None, 9, 9)]
    found = spark.createDataFrame([r[:2] for r in rows], "s int, r int").select(states.reconciled_count(F.col("s"), F.col("r")).alias("n")).collect()
    assert [r.n for r in found] == [n for _, _, n in rows]


def test_what_carries_out_a_skill(spark):
    parts = {'[{"type":"tool_call","tool_name":"Bash"}]': True, '[{"type":"text","tool_name":"Bash"}]': False, '[{"type":"tool_call","tool_name":"Read"},{"type":"tool_call","tool_name":"edit_file"}]': True, '[{"type":"tool_call"}]': False, "no json": False, None: False}
    rows = spark.createDataFrame([(p,) for p in parts], "p string").select("p", hits.carries_out(F.col("p")).alias("does")).collect()
    assert {r.p: r.does for r in rows} == parts
