"""STR, SNK and MAT: streaming operators in batch form, and one that runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import filters
from pulsegrid.shared import own_folder, stage
from pulsegrid.streaming import ingest, live, sinks, states

from .bindings import Lake
from .recursions import CLAIMED, SENT, throttled_sql
from .registry import Registry

query = Registry()
SNAP = "snap AS (SELECT 'u' || user_id AS session, ts AS captured_at, event_id AS seq, event_type AS status, CAST(floor(value) AS BIGINT) AS tokens, user_id % 5 + event_id % 3 AS messages FROM events)"
LAGGED = "lagged AS (SELECT *, lag(status) OVER w AS ps, lag(tokens) OVER w AS pt, lag(messages) OVER w AS pm, lag(captured_at) OVER w AS pc FROM snap WINDOW w AS (PARTITION BY session ORDER BY captured_at, seq))"
DELTAS = f"""WITH {SNAP}, {LAGGED} SELECT session, captured_at AS event_time, 'SESSION_OPEN' AS event_type, status, 0 AS tokens_delta, 0 AS messages_delta FROM lagged WHERE ps IS NULL
    UNION ALL SELECT session, captured_at, 'STATUS_CHANGE', status, 0, 0 FROM lagged WHERE status <> ps UNION ALL SELECT session, captured_at, 'TOKEN_DELTA', status, tokens - coalesce(pt, 0), 0 FROM lagged WHERE tokens - coalesce(pt, 0) > 0
    UNION ALL SELECT session, captured_at, 'MESSAGE_DELTA', status, 0, messages - coalesce(pm, 0) FROM lagged WHERE messages - coalesce(pm, 0) > 0"""


def snapshots(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("u"), "user_id").alias("session"), F.col("ts").alias("captured_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.floor("value").cast("long").alias("tokens"), (F.col("user_id") % 5 + F.col("event_id") % 3).alias("messages"))


@query("str_1", DELTAS)
def str_1(t: Lake) -> DataFrame:
    return states.snapshot_events_batch(snapshots(t.source("events")))


@query("str_1_stream", DELTAS)
def str_1_stream(t: Lake) -> DataFrame:
    """The same, run as a stream with state to its end."""
    spark, folder = t.spark, own_folder(t.spark, "stream")
    schema = t.source("events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events*.parquet")
    out = states.snapshot_events(snapshots(stream))
    job = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("str_2", "SELECT id, 'TOKEN_DELTA' AS event_type, greatest(tokens_delta, 0) AS amount FROM event UNION ALL SELECT id, 'MESSAGE_DELTA', greatest(messages_delta, 0) FROM event")
def str_2(t: Lake) -> DataFrame:
    both = F.array(F.struct(F.lit("TOKEN_DELTA").alias("event_type"), F.greatest("tokens_delta", F.lit(0)).alias("amount")), F.struct(F.lit("MESSAGE_DELTA").alias("event_type"), F.greatest("messages_delta", F.lit(0)).alias("amount")))
    return t.event.select("id", F.inline(both))


@query("str_3", "SELECT m.id, m.input_tokens + m.output_tokens AS tokens_delta FROM message m WHERE NOT EXISTS (SELECT 1 FROM event e WHERE e.session_id = m.session_id AND e.event_type = 'TOKEN_DELTA')")
def str_3(t: Lake) -> DataFrame:
    timed = t.event.where("event_type = 'TOKEN_DELTA'").select("session_id")
    return t.message.join(timed, "session_id", "left_anti").select("id", F.expr("input_tokens + output_tokens").alias("tokens_delta"))


@query("str_4", "SELECT session_id, tool_name, min(id) AS id FROM event WHERE tool_name IS NOT NULL GROUP BY 1, 2")
def str_4(t: Lake) -> DataFrame:
    return t.event.where("tool_name is not null").groupBy("session_id", "tool_name").agg(F.min("id").alias("id"))


@query("str_5", "SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN last_activity END, started_at) AS event_time FROM session")
def str_5(t: Lake) -> DataFrame:
    return t.session.select("id", F.coalesce(F.when(F.col("id") % 3 != 0, F.col("last_activity")), F.col("started_at")).alias("event_time"))


LIVED = """lived AS (SELECT id, CASE target_type WHEN 'high' THEN 'claude' ELSE target_type END AS target_type, status, user_messages, assistant_messages, CASE WHEN id % 3 = 0 THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN id % 2 = 0 THEN 0 ELSE output_tokens END AS output_tokens,
    CASE WHEN id % 7 = 0 THEN 'merged_subagent' ELSE invalid_reason END AS stored FROM session)"""


@query("str_6", f"""WITH {LIVED}, x AS (SELECT *, status = 'idle' AND user_messages > 0 AND assistant_messages = 0 AND input_tokens = 0 AND output_tokens = 0 AS lifeless FROM lived)
    SELECT id, CASE WHEN stored = 'merged_subagent' THEN stored WHEN lifeless THEN coalesce(stored, CASE target_type WHEN 'claude' THEN 'local_command_only' ELSE 'no_assistant_reply' END) END AS reason FROM x""")  # fmt: skip
def str_6(t: Lake) -> DataFrame:
    """Why sessions do not count: no life at all, for as long as that lasts, or merged into another for good."""
    n = F.col("id")
    rows = t.session.withColumns({"input_tokens": F.when(n % 3 == 0, 0).otherwise(F.col("input_tokens")), "output_tokens": F.when(n % 2 == 0, 0).otherwise(F.col("output_tokens")), "stored": F.when(n % 7 == 0, ingest.MERGED).otherwise(F.col("invalid_reason")), "target_type": F.when(F.col("target_type") == "high", "claude").otherwise(F.col("target_type"))})
    return rows.select("id", ingest.reason(ingest.lifeless(F.col("input_tokens"), F.col("output_tokens")), F.lit(True), F.col("stored"), F.col("target_type")).alias("reason"))


@query("str_7", """WITH listed AS (SELECT DISTINCT 'a' || (l_orderkey % 150 % 97) AS agent_id, 'ext-' || (l_orderkey + l_linenumber % 2) AS ref FROM lineitem WHERE l_linenumber IN (1, 4))
    SELECT s.id, CASE WHEN listed.ref IS NOT NULL THEN 'merged_subagent' ELSE s.invalid_reason END AS invalid_reason FROM session s LEFT JOIN listed ON listed.ref = s.external_session_id AND listed.agent_id = s.agent_id""")  # fmt: skip
def str_7(t: Lake) -> DataFrame:
    """Sessions that a client lists as merged into another become so, if they are that client's own."""
    listed = t.source("lineitem").where("l_linenumber in (1, 4)").select(F.concat(F.lit("a"), F.col("l_orderkey") % 150 % 97).alias("agent_id"), F.concat(F.lit("ext-"), F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("external_session_id")).distinct()
    marked = t.session.join(listed.withColumn("_listed", F.lit(True)), ["agent_id", "external_session_id"], "left")
    return marked.select("id", F.when(F.col("_listed"), "merged_subagent").otherwise(F.col("invalid_reason")).alias("invalid_reason"))


@query("str_8", """WITH m AS (SELECT session_id, count(*) FILTER (lower(trim(role)) = 'user') AS u, count(*) FILTER (lower(trim(role)) = 'assistant') AS a, count(*) AS n FROM message WHERE session_id % 5 <> 0 GROUP BY 1), x AS (SELECT id, id % 400 AS reported, user_messages, assistant_messages, coalesce(n, 0) AS n, u, a FROM session LEFT JOIN m ON session_id = id)
    SELECT id, CASE WHEN n > 0 AND reported > 0 AND (n >= reported OR reported - n <= 200) THEN n ELSE reported END AS shown, CASE WHEN reported <= 0 THEN greatest(reported, n) WHEN id % 2 = 0 AND n > 0 THEN n ELSE reported END AS snapshot,
      CASE WHEN n > 0 THEN u ELSE user_messages END AS user_messages, CASE WHEN n > 0 THEN a ELSE assistant_messages END AS assistant_messages FROM x""")  # fmt: skip
def str_8(t: Lake) -> DataFrame:
    """Message counts of sessions against what is stored; every fifth session has nothing stored, every second client has sent all."""
    counts = t.message.where("session_id % 5 <> 0").groupBy(F.col("session_id").alias("id")).agg(F.count_if(filters.role() == "user").alias("u"), F.count_if(filters.role() == "assistant").alias("a"), F.count(F.lit(1)).alias("n"))
    rows = t.session.select("id", "user_messages", "assistant_messages", (F.col("id") % 400).alias("reported")).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stored = F.col("n") > 0
    sides = [F.when(stored, F.col(c)).otherwise(F.col(name)).alias(name) for c, name in (("u", "user_messages"), ("a", "assistant_messages"))]
    return rows.select("id", states.reconciled_count(F.col("n"), F.col("reported")).alias("shown"), states.reported_snapshot(F.col("n"), F.col("reported"), F.col("id") % 2 == 0).alias("snapshot"), *sides)


@query("str_9", "SELECT DISTINCT CAST(event_time AS DATE) AS day, user_code FROM event WHERE event_time >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND event_time < TIMESTAMP '1998-01-01' - INTERVAL 48 HOUR")
def str_9(t: Lake) -> DataFrame:
    """The (day, user) pairs that late rows make stale: older than the steady look-back, within the first one."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    late = (F.col("event_time") >= now - F.make_dt_interval(days=F.lit(30))) & (F.col("event_time") < now - F.make_dt_interval(hours=F.lit(48)))
    return t.event.where(late).select(F.to_date("event_time").alias("day"), "user_code").distinct()


@query("str_11", "SELECT id, 'idle' AS status FROM session WHERE status <> 'idle' AND last_activity < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND ORDER BY id LIMIT 500")
def str_11(t: Lake) -> DataFrame:
    cut = F.lit("1998-01-01").cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(300))
    return t.session.where((F.col("status") != "idle") & (F.col("last_activity") < cut)).orderBy("id").limit(500).select("id", F.lit("idle").alias("status"))


@query("str_12", """WITH x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'thinking' WHEN 1 THEN 'waiting_for_user' WHEN 2 THEN 'executing_tool' ELSE 'other' END AS b, CASE id % 7 WHEN 0 THEN 'run_terminal_command_v2' WHEN 1 THEN 'spawn_subagent' WHEN 2 THEN 'read_file' WHEN 3 THEN 'codebase_search' WHEN 4 THEN 'web_fetch' WHEN 5 THEN 'custom' END AS tool,
      epoch(last_activity - started_at)::BIGINT // 60 % 150 AS since, CASE WHEN id % 5 = 0 THEN id % 90 END AS ta, CASE WHEN id % 11 = 0 THEN id % 80 END AS sa FROM session),
    y AS (SELECT *, CASE tool WHEN 'run_terminal_command_v2' THEN 'running' WHEN 'spawn_subagent' THEN 'spawning' WHEN 'read_file' THEN 'reading' WHEN 'codebase_search' THEN 'searching' WHEN 'web_fetch' THEN 'browsing' WHEN 'custom' THEN 'running' ELSE 'idle' END AS ts FROM x)
    SELECT id, CASE WHEN sa < 50 THEN 'compacting' WHEN ta < 50 THEN ts WHEN b = 'waiting_for_user' THEN CASE WHEN since < 120 THEN 'waiting' ELSE 'idle' END WHEN b = 'executing_tool' AND ts = 'spawning' AND since < 1200 THEN 'spawning'
      WHEN b = 'thinking' AND since <= 50 THEN 'thinking' WHEN since > 50 THEN 'idle' WHEN b = 'executing_tool' THEN ts ELSE 'idle' END AS state FROM y""")  # fmt: skip
def str_12(t: Lake) -> DataFrame:
    """Activity states of clients that report every twenty seconds, with the tools' own names."""
    n = F.col("id")
    bubble = F.when(n % 4 == 0, "thinking").when(n % 4 == 1, "waiting_for_user").when(n % 4 == 2, "executing_tool").otherwise("other")
    tool = F.get(F.array(*[F.lit(x) for x in ("run_terminal_command_v2", "spawn_subagent", "read_file", "codebase_search", "web_fetch", "custom")]), (n % 7).cast("int"))
    since = F.floor((F.unix_seconds(F.col("last_activity").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) / 60) % 150
    return t.session.select("id", states.activity_state(bubble, tool, since, F.when(n % 5 == 0, n % 90), F.when(n % 11 == 0, n % 80), interval=20).alias("state"))


@query("str_13", """WITH p AS (SELECT agent_id, date_trunc('second', start_time) AS ping, id FROM work), g AS (SELECT *, CASE WHEN ping > lag(ping) OVER (PARTITION BY agent_id ORDER BY ping, id) + INTERVAL 180 SECOND THEN 1 ELSE 0 END AS fresh FROM p),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id ORDER BY ping, id ROWS UNBOUNDED PRECEDING) AS span FROM g) SELECT agent_id, min(ping) AS started, max(ping) AS last_ping, count(*) AS pings FROM s GROUP BY agent_id, span""")  # fmt: skip
def str_13(t: Lake) -> DataFrame:
    found = states.work_sessions(t.work, "agent_id", "start_time")
    return found.select("agent_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_ping").cast("timestamp_ntz").alias("last_ping"), "pings")


def reported(activity: DataFrame) -> DataFrame:
    """Snapshots of five clients: id, client, signal_time, print and whether the session is idle."""
    idle = F.col("event_type").isin("view", "click", "error")
    print_ = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 1).otherwise(0) + F.when(idle, 10).otherwise(0)
    return activity.select("id", F.concat(F.lit("c"), F.col("id") % 5).alias("client"), "signal_time", print_.cast("long").alias("print"), idle.alias("idle"))


@query("str_16", SENT)
def str_16(t: Lake) -> DataFrame:
    """Snapshots that are sent: not those of idle sessions that look as the last one sent within a quarter of an hour."""
    found = live.folded(reported(t.activity), "client", "signal_time", [F.col("id"), F.col("print"), F.col("idle")], live.Unchanged())
    return found.select(F.col("key").alias("client"), "id")


@query("str_17", CLAIMED)
def str_17(t: Lake) -> DataFrame:
    """Requests that are no replays, and were sent within five minutes of their arrival."""
    requests = t.work.select("id", "agent_id", "start_time", "end_time", (F.col("id") % 3).alias("nonce"))
    return states.first_claims(requests, ["agent_id", "nonce"], "start_time", "id", "end_time").select("id")


@query("str_18", throttled_sql("activity", "user_code", "signal_time", 3600))
def str_18(t: Lake) -> DataFrame:
    return states.throttled(t.activity, "user_code", "signal_time", 3600)


@query("str_19", """WITH w AS (SELECT id AS session_id, 'SESSION_OPEN' AS event_type, 0 AS amount FROM session UNION ALL SELECT id, 'TOKEN_DELTA', input_tokens + output_tokens FROM session WHERE input_tokens + output_tokens > 0 UNION ALL SELECT id, 'MESSAGE_DELTA', total_messages FROM session WHERE total_messages > 0)
    SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM event e WHERE e.session_id = w.session_id AND e.event_type = w.event_type)""")  # fmt: skip
def str_19(t: Lake) -> DataFrame:
    return states.missing_baseline(t.session, t.event)


@query("str_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def str_windows(t: Lake) -> DataFrame:
    hours = t.source("events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("total"))
    return hours.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "total")


@query("snk_1", "SELECT target_type, external_id, max(place) AS version, arg_max(id, place) AS id FROM (SELECT *, version * 100000000 + id AS place, 'x' || (id % 1000) AS external_id FROM session) GROUP BY 1, 2")
def snk_1(t: Lake) -> DataFrame:
    """Sessions by type and external id, upserted in two batches: the table is written, merged with the second batch, and written anew."""
    keys = ["target_type", "external_id"]
    slim = t.session.select("target_type", F.concat(F.lit("x"), F.col("id") % 1000).alias("external_id"), "id", "status", (F.col("version") * 100_000_000 + F.col("id")).alias("version"))
    stored = stage(sinks.keep_latest(slim.where("status = 'idle'"), keys, F.desc("version")), "sessions")
    return stage(sinks.merged(stored, slim.where("status <> 'idle'"), keys, "version"), "sessions").select(*keys, "version", "id")


@query("snk_2", "SELECT DISTINCT session_id, tool_name FROM event WHERE id % 2 = 1 AND (session_id, tool_name) NOT IN (SELECT session_id, tool_name FROM event WHERE id % 2 = 0 AND tool_name IS NOT NULL) AND tool_name IS NOT NULL")
def snk_2(t: Lake) -> DataFrame:
    calls = t.event.where("tool_name is not null").select("id", "session_id", "tool_name")
    return sinks.not_stored(calls.where("id % 2 = 1"), calls.where("id % 2 = 0"), ["session_id", "tool_name"]).select("session_id", "tool_name")


@query("snk_5", """WITH f AS (SELECT commit_id, id % 2 AS half, count(*) AS files, count(*) FILTER (has_patch) AS patches FROM commit_file GROUP BY 1, 2)
    SELECT commit_id, half, files, patches FROM f QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY patches DESC, files DESC, half) = 1""")  # fmt: skip
def snk_5(t: Lake) -> DataFrame:
    """Of two reports of a commit's files the one with more patches, or else more files; the stored one if they are alike."""
    told = t.commit_file.groupBy("commit_id", (F.col("id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("files"), F.count_if("has_patch").alias("patches"))
    stored = stage(told.where("half = 0"), "commits")
    return sinks.richer(stored, told.where("half = 1"), ["commit_id"], "patches", "files")


@query("mat_6", """WITH n AS (SELECT CAST(event_time AS DATE) AS work_date, max(event_time) AS newest FROM event GROUP BY 1), b AS (SELECT CAST(message_time AS DATE) AS work_date, max(message_time) AS built FROM message GROUP BY 1)
    SELECT coalesce(n.work_date, b.work_date) AS work_date FROM n FULL JOIN b ON n.work_date = b.work_date WHERE newest IS NULL OR built IS NULL OR newest > built""")  # fmt: skip
def mat_6(t: Lake) -> DataFrame:
    summary = t.message.select(F.to_date("message_time").alias("work_date"), F.col("message_time").alias("updated_time"))
    return sinks.stale_days(t.event, summary)


@query("mat_7", "SELECT id, CASE WHEN message_time >= TIMESTAMP '1998-01-01' THEN content_text END AS content_text FROM message")
def mat_7(t: Lake) -> DataFrame:
    return sinks.without_content(t.message, "message_time", "1998-01-01", ["content_text"]).select("id", "content_text")


@query("mat_10", "SELECT id FROM event WHERE user_code <> 'u7'")
def mat_10(t: Lake) -> DataFrame:
    gone = t.session.where("user_code = 'u7'").select("user_code").distinct()
    return t.event.join(gone, "user_code", "left_anti").select("id")


QUERIES, ORACLES = query.queries, query.oracles
