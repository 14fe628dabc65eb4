"""The sources on small files of the shapes they read."""

import json
import sqlite3
import subprocess
from datetime import datetime

from pulsegrid.sources import gitlog, keyvalue, transcripts


def test_gitlog(spark, tmp_path):
    repo = tmp_path / "work" / "project"
    repo.mkdir(parents=True)

    def git(*args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@x.y", *args], check=True, capture_output=True)

    git("init", "-q")
    for n in (1, 2):
        (repo / "file.txt").write_text("line\n" * n)
        git("add", ".")
        git("commit", "-q", "-m", f"subject {n}\n\nbody {n}")
    (tmp_path / "node_modules" / "dep" / ".git").mkdir(parents=True)
    spark.dataSource.register(gitlog.GitLog)
    rows = spark.read.format("gitlog").option("root", str(tmp_path)).load().orderBy("subject").collect()
    assert [(r.subject, r.body, r.files_changed, r.lines_added, r.lines_deleted, len(r.parents)) for r in rows] == [("subject 1", "body 1", 1, 1, 0, 0), ("subject 2", "body 2", 1, 1, 0, 1)]
    first = rows[0].commit_hash
    later = spark.read.format("gitlog").option("root", str(tmp_path)).option("since", first).load()
    assert [r.subject for r in later.collect()] == ["subject 2"]
    lost = spark.read.format("gitlog").option("root", str(tmp_path)).option("since", "0" * 40).load()
    assert lost.count() == 2


def test_key_value_store(spark, tmp_path):
    path = tmp_path / "state.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE kv (key TEXT, value BLOB)")
        db.executemany("INSERT INTO kv VALUES (?, ?)", [("bubble:1", "a"), ("bubble:2", "b"), ("bubblf", "c"), ("other", None)])
    spark.dataSource.register(keyvalue.KeyValueStore)

    def read(**options):
        reader = spark.read.format("sqlite_kv").option("path", str(path))
        for name, value in options.items():
            reader = reader.option(name, value)
        return [r.key for r in reader.load().orderBy("row_id").collect()]

    assert read() == ["bubble:1", "bubble:2", "bubblf", "other"]
    assert read(prefix="bubble:") == ["bubble:1", "bubble:2"]
    assert read(prefix="bubble:", after="1") == ["bubble:2"]


def test_messages_of_a_transcript(spark, tmp_path):
    def entry(kind, content, at, **more):
        return json.dumps({"type": kind, "uuid": at, "sessionId": "s", "cwd": "/w", "timestamp": f"2026-01-01T00:00:{at}Z", "message": {"role": kind, "content": content, **more}})

    used = {"input_tokens": 5, "output_tokens": 7}
    lines = [
        entry("user", "hello", "01"),
        entry("assistant", [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "id": "t"}], "02", model="m", usage=used),
        entry("user", [{"type": "tool_result", "tool_use_id": "t"}], "03"),
        "not json",
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    messages = transcripts.message_rows(transcripts.parsed(transcripts.lines(spark, str(tmp_path)), transcripts.ENTRY))
    rows = messages.orderBy("message_time").collect()
    assert [(r.role, r.tools) for r in rows] == [("user", []), ("assistant", ["Bash"]), ("tool", [])]
    session = transcripts.sessions(messages).first()
    assert (session.user_messages, session.assistant_messages, session.input_tokens, session.output_tokens, session.model) == (1, 1, 5, 7, "m")


def test_cumulative_counters(spark, tmp_path):
    def counted(at, given, made):
        return json.dumps({"timestamp": f"2026-01-01T00:00:{at}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": given, "output_tokens": made}}}})

    (tmp_path / "c.jsonl").write_text("\n".join([counted("01", 10, 1), counted("02", 10, 1), counted("03", 25, 4), counted("04", 5, 4)]))
    rows = transcripts.counter_deltas(transcripts.parsed(transcripts.lines(spark, str(tmp_path)), transcripts.ENVELOPE)).orderBy("at").collect()
    assert [(r.input_tokens, r.output_tokens) for r in rows] == [(10, 1), (15, 3)]


def test_untimed_turns(spark):
    start, end = datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 1)
    rows = transcripts.untimed_turns(spark.createDataFrame([("s", start, end, 10, ["user", "assistant", "user"])], "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, total_tokens long, roles array<string>")).orderBy("pos").collect()
    assert [r.message_time.second + 60 * r.message_time.minute for r in rows] == [0, 30, 60]
    assert [r.tokens for r in rows] == [3, 3, 3]
