"""PRJ, SRT, FN and further entries: narrow slices, orders, fills, cursors and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.operators import filters, joins, shapes, stats
from pulsegrid.shared import stage
from pulsegrid.streaming import live, sinks, states

from .aggregates import END, START
from .bindings import Lake
from .recursions import ALERTS, MARKS, due_sql, throttled_sql
from .registry import Registry
from .relational import NOW, half_open

query = Registry()


# ---- slices that feed the ordered operators


@query("prj_1", "SELECT user_code, CAST(event_time AS DATE) AS day, session_id, event_time, event_type, status, row_number() OVER (PARTITION BY user_code, CAST(event_time AS DATE) ORDER BY event_time, id) AS place FROM event")
def prj_1(t: Lake) -> DataFrame:
    """Events of each user's days in order."""
    day = F.to_date("event_time").alias("day")
    return t.event.select("user_code", day, "id", "session_id", "event_time", "event_type", "status").withColumn("place", F.row_number().over(W.partitionBy("user_code", "day").orderBy("event_time", "id")).cast("long")).drop("id")


@query("prj_2", "SELECT user_code, CAST(message_time AS DATE) AS day, session_id, lower(trim(role)) AS role, message_time, row_number() OVER (PARTITION BY user_code, CAST(message_time AS DATE) ORDER BY session_id, seq, id, message_time) AS place FROM message")
def prj_2(t: Lake) -> DataFrame:
    """Messages of each user's days by session and sequence."""
    rows = t.message.select("user_code", F.to_date("message_time").alias("day"), "id", "session_id", "seq", filters.role().alias("role"), "message_time")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("user_code", "day").orderBy("session_id", "seq", "id", "message_time")).cast("long")).drop("id", "seq")


@query("prj_3", "SELECT user_code, CAST(last_activity AS DATE) AS day, id, model, input_tokens, output_tokens FROM session WHERE invalid_reason IS NULL")
def prj_3(t: Lake) -> DataFrame:
    """Tokens and models of each user's days."""
    return filters.valid(t.session).select("user_code", F.to_date("last_activity").alias("day"), "id", "model", "input_tokens", "output_tokens")


@query("prj_4", "SELECT id, user_code, project_name, target_type, status, current_tool, last_activity FROM session WHERE status <> 'idle'")
def prj_4(t: Lake) -> DataFrame:
    return t.session.where("status <> 'idle'").select("id", "user_code", "project_name", "target_type", "status", "current_tool", "last_activity")


@query("prj_7", "SELECT session_id, tool_name, event_time FROM event WHERE event_type = 'TOOL_CALL'")
def prj_7(t: Lake) -> DataFrame:
    """The keys by which repeated tool calls are told."""
    return t.event.where("event_type = 'TOOL_CALL'").select("session_id", "tool_name", "event_time")


@query("prj_8", "SELECT id, conversation_order, message_time, date_diff('hour', message_time, TIMESTAMP '1999-01-01') AS age_hours, slash_command_count, slash_skill_count FROM message")
def prj_8(t: Lake) -> DataFrame:
    """Order, age and audit fields of messages; the age counts the hour boundaries passed."""
    age = F.expr("timestampdiff(HOUR, date_trunc('HOUR', message_time), timestamp_ntz '1999-01-01')")
    return t.message.select("id", "conversation_order", "message_time", age.alias("age_hours"), "slash_command_count", "slash_skill_count")


@query("prj_10", "SELECT id, commit_id, path, old_path FROM commit_file")
def prj_10(t: Lake) -> DataFrame:
    return t.commit_file.select("id", "commit_id", "path", "old_path")


@query("flt_31", "SELECT id, config_key, category, changed_time, row_number() OVER (PARTITION BY config_key, category ORDER BY changed_time DESC, id DESC) AS place FROM config_change")
def flt_31(t: Lake) -> DataFrame:
    """Changes of the settings by key and category, newest first."""
    newest = W.partitionBy("config_key", "category").orderBy(F.desc("changed_time"), F.desc("id"))
    return t.config_change.select("id", "config_key", "category", "changed_time", F.row_number().over(newest).cast("long").alias("place"))


# ---- orders and pages


@query("srt_1", f"SELECT user_code, CAST(sum(tokens_delta) AS BIGINT) AS tokens FROM event WHERE {half_open('event_time')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def srt_1(t: Lake) -> DataFrame:
    return t.event.where(filters.between("event_time", START, END)).groupBy("user_code").agg(F.sum("tokens_delta").alias("tokens")).orderBy(F.desc("tokens"), "user_code").limit(5)


@query("srt_2", "SELECT user_code, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM session GROUP BY 1 ORDER BY 2 DESC, 1")
def srt_2(t: Lake) -> DataFrame:
    return t.session.groupBy("user_code").agg(F.sum(F.expr("input_tokens + output_tokens")).alias("tokens")).orderBy(F.desc("tokens"), "user_code")


@query("srt_6", "SELECT id, user_code FROM session WHERE id > (SELECT max(id) FROM (SELECT id FROM session ORDER BY id LIMIT 50)) ORDER BY id LIMIT 50")
def srt_6(t: Lake) -> DataFrame:
    """The second page: what comes after the last id of the first."""
    last = t.session.orderBy("id").limit(50).agg(F.max("id").alias("_last"))
    return t.session.select("id", "user_code").join(F.broadcast(last), F.col("id") > F.col("_last")).orderBy("id").limit(50).select("id", "user_code")  # one row


@query("srt_7", """WITH w AS (SELECT model, CAST(signal_time AS DATE) AS day, tokens FROM activity WHERE CAST(signal_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'), top AS (SELECT model, row_number() OVER (ORDER BY sum(tokens) DESC, model) - 1 AS place FROM w GROUP BY 1 ORDER BY 2 LIMIT 8)
    SELECT place, day - DATE '2024-01-05' AS day_index, CAST(sum(tokens) AS BIGINT) AS tokens FROM w JOIN top USING (model) GROUP BY 1, 2""")  # fmt: skip
def srt_7(t: Lake) -> DataFrame:
    """Cells of the eight models with the most tokens in the window, by their coordinates."""
    cells = t.activity.groupBy(F.to_date("signal_time").alias("day"), "model").agg(F.sum("tokens").alias("tokens")).where("day between date '2024-01-05' and date '2024-01-18'")
    totals = cells.groupBy("model").agg(F.sum("tokens").alias("_t")).orderBy(F.desc("_t"), "model").limit(8)
    top = totals.select("model", (F.row_number().over(W.orderBy(F.desc("_t"), "model")) - 1).cast("long").alias("place"))  # eight rows
    return cells.join(F.broadcast(top), "model").select("place", F.date_diff("day", F.lit("2024-01-05").cast("date")).cast("long").alias("day_index"), "tokens")


@query("srt_11", "SELECT id, session_id, n - back AS place FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY conversation_order DESC NULLS FIRST, message_time DESC, id DESC) - 1 AS back FROM message) WHERE back < 4")
def srt_11(t: Lake) -> DataFrame:
    """The last four messages of a session: explicit order first, then time, then id."""
    own = W.partitionBy("session_id")
    back = F.row_number().over(own.orderBy(F.desc_nulls_first("conversation_order"), F.desc("message_time"), F.desc("id"))) - 1
    rows = t.message.select("id", "session_id", F.count(F.lit(1)).over(own).alias("n"), back.alias("back"))
    return rows.where("back < 4").select("id", "session_id", (F.col("n") - F.col("back")).alias("place"))


ONLINE = f"SELECT d.id, d.agent_id, true AS online, CAST(coalesce(w.duration_seconds, 0) AS BIGINT) AS seconds FROM device d LEFT JOIN (SELECT agent_id, sum(duration_seconds) AS duration_seconds FROM work GROUP BY 1) w USING (agent_id) WHERE status = 'ACTIVE' AND last_seen > TIMESTAMP '{NOW}' - INTERVAL 300 SECOND"
OFFLINE = f"SELECT id, agent_id, false AS online, epoch(TIMESTAMP '{NOW}' - last_seen)::BIGINT AS seconds FROM device WHERE status = 'ACTIVE' AND last_seen <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND"


@query("srt_12", f"SELECT * FROM ({ONLINE} UNION ALL {OFFLINE}) ORDER BY online DESC, seconds DESC, agent_id, id")
def srt_12(t: Lake) -> DataFrame:
    """Online devices by time worked, then offline ones by how long they are."""
    worked = t.work.groupBy("agent_id").agg(F.sum("duration_seconds").alias("seconds"))
    known = t.device.where("status = 'ACTIVE' and last_seen is not null").withColumn("online", filters.online(NOW)).join(worked, "agent_id", "left")
    since = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    rows = known.select("id", "agent_id", "online", F.when(F.col("online"), F.coalesce("seconds", F.lit(0))).otherwise(since).alias("seconds"))
    return rows.orderBy(F.desc("online"), F.desc("seconds"), "agent_id", "id")


@query("win_12", "SELECT user_code, id FROM (SELECT *, row_number() OVER (PARTITION BY user_code ORDER BY last_activity DESC, id) AS n FROM session) WHERE n = 1")
def win_12(t: Lake) -> DataFrame:
    """The latest session of each user."""
    return joins.latest(t.session, ["user_code"], F.desc("last_activity"), F.col("id")).select("user_code", "id")


@query("win_15", "SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_time DESC, id DESC) AS n FROM event) WHERE n <= 3")
def win_15(t: Lake) -> DataFrame:
    """The last three events of each session."""
    last = W.partitionBy("session_id").orderBy(F.desc("event_time"), F.desc("id"))
    return t.event.withColumn("n", F.row_number().over(last)).where("n <= 3").select("session_id", "id")


# ---- fills, windows, percentiles


@query("fn_g6", "WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-20', DATE '2024-01-20' + 91, INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, coalesce(n, 0) AS signals FROM d LEFT JOIN (SELECT CAST(signal_time AS DATE) AS day, count(*) AS n FROM activity GROUP BY 1) USING (day)")
def fn_g6(t: Lake) -> DataFrame:
    """A report's time line, of 92 days at most, with zeros where nothing was."""
    daily = t.activity.groupBy(F.to_date("signal_time").alias("day")).agg(F.count(F.lit(1)).alias("signals"))
    return shapes.gap_filled(daily, "day", ["signals"], "2024-01-20", shapes.last_day("2024-01-20", "2024-12-31", 92))


@query("fn_g9", "SELECT id, CAST(date_trunc('week', ts) AS DATE) AS week_from, CAST(date_trunc('week', ts) AS DATE) + 6 AS week_to, least(CAST(date_trunc('week', ts) AS DATE) + 6, DATE '2024-01-17') AS elapsed_to, DATE '2024-01-17' - 29 AS month_from FROM (SELECT id, signal_time AS ts FROM activity) WHERE CAST(ts AS DATE) <= DATE '2024-01-17'")
def fn_g9(t: Lake) -> DataFrame:
    """The windows that a moment falls in: its ISO week, as far as it has passed, and the last thirty days."""
    today = F.lit("2024-01-17").cast("date")
    first, last = shapes.iso_week(F.col("signal_time"))
    rows = t.activity.where(F.to_date("signal_time") <= today)
    return rows.select("id", first.alias("week_from"), last.alias("week_to"), F.least(last, today).alias("elapsed_to"), F.date_sub(today, 29).alias("month_from"))


@query("st_1", "SELECT project_name, floor(quantile_cont(CAST(output_tokens AS DOUBLE), 0.3) * 1000 + 0.5) / 1000 AS p30, floor(quantile_cont(CAST(output_tokens AS DOUBLE), 0.95) * 1000 + 0.5) / 1000 AS p95 FROM session GROUP BY 1")
def st_1(t: Lake) -> DataFrame:
    return stats.percentiles(t.session.withColumn("x", F.col("output_tokens").cast("double")), ["project_name"], "x", (30, 95))


@query("agg_d4", f"{due_sql(MARKS, 'work_date', 'signal_time')} SELECT work_date, max(due) AS updated_time FROM builds GROUP BY 1")
def agg_d4(t: Lake) -> DataFrame:
    """When each day's summary was last built: the last time that its debounced builds (STR-10) were due."""
    marks = t.activity.withColumn("work_date", F.to_date("signal_time"))
    built = live.folded(marks, "work_date", "signal_time", [F.when(F.col("event_type") != "signup", F.col("user_code")).alias("user")], live.Debounce())
    return built.groupBy(F.col("key").cast("date").alias("work_date")).agg(F.max("at").alias("updated_time"))


# ---- streams in batch form


@query("str_14", "SELECT agent_id, max(id) AS last_id, max(start_time) AS last_time FROM work WHERE start_time >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY GROUP BY 1")
def str_14(t: Lake) -> DataFrame:
    """Where each client's next batch begins; what is older than the retention is forgotten."""
    return states.cursors(t.work, "agent_id", "id", "start_time", "2024-01-31", 15)


@query("str_15", """WITH m AS (SELECT id, user_code, length(content_text) AS bytes, row_number() OVER (PARTITION BY user_code ORDER BY id) - 1 AS i, sum(length(content_text)) OVER (PARTITION BY user_code ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM message)
    SELECT id, user_code, greatest(i // 200, (upto - bytes) // 4000) AS batch FROM m""")  # fmt: skip
def str_15(t: Lake) -> DataFrame:
    """Batches of a client's messages: none of over 200 rows or, but for its last row, 4,000 bytes."""
    return states.batched(t.message.withColumn("bytes", F.octet_length("content_text")), "user_code", "id", "bytes", 200, 4_000).select("id", "user_code", "batch")


@query("str_10", f"{due_sql('activity', 'user_code', 'signal_time')} SELECT user_code, due, last - place + 1 AS marks FROM builds")
def str_10(t: Lake) -> DataFrame:
    """When each user's summary is built, if signals put it off for 15 seconds, 60 at most."""
    return states.debounced(t.activity, "user_code", "signal_time")


@query("str_20", throttled_sql(ALERTS, "alert", "signal_time", 600))
def str_20(t: Lake) -> DataFrame:
    """Alerts by user and kind, one in ten minutes; each says how many were held back before it."""
    alerts = t.activity.withColumn("alert", F.concat_ws("|", "user_code", "event_type"))
    return states.throttled(alerts, "alert", "signal_time", 600)


# ---- stored content and materialised tables


@query("snk_3", """WITH m AS (SELECT session_id, id, seq, seq % 5 AS external_id, message_time FROM message), first AS (SELECT * FROM m WHERE seq <= 3 QUALIFY row_number() OVER (PARTITION BY session_id, external_id ORDER BY id, message_time) = 1)
    SELECT session_id, external_id, id, message_time FROM first UNION ALL SELECT session_id, external_id, id, message_time FROM m WHERE seq >= 3 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.session_id = m.session_id AND f.external_id = m.external_id)
      QUALIFY row_number() OVER (PARTITION BY session_id, external_id ORDER BY id, message_time) = 1""")  # fmt: skip
def snk_3(t: Lake) -> DataFrame:
    """Messages appended in two batches, the second with old keys and new ones; a key that is stored is not stored again."""
    keys, order = ["session_id", "external_id"], [F.col("id"), F.col("message_time")]
    rows = t.message.select("session_id", (F.col("seq") % 5).alias("external_id"), "id", "message_time", "seq")
    once = lambda where: sinks.keep_latest(rows.where(where), keys, *order).drop("seq")
    stored = stage(once("seq <= 3"), "messages")
    return stored.unionByName(sinks.not_stored(once("seq >= 3"), stored, keys).select(stored.columns))


@query("snk_4", "SELECT sha256(content_text) AS digest, count(*) AS links, CAST(any_value(length(content_text)) AS INTEGER) AS bytes FROM message GROUP BY 1")
def snk_4(t: Lake) -> DataFrame:
    """Contents stored once each by their digest, with the number of messages that link to them."""
    blobs, links = sinks.content_addressed(t.message, "id", "content_text")
    return links.groupBy("digest").agg(F.count(F.lit(1)).alias("links")).join(blobs.select("digest", F.length("content").alias("bytes")), "digest")


@query("snk_6", "SELECT work_month, CAST(sum(tokens_delta) AS BIGINT) + CASE WHEN work_month >= DATE '1998-06-01' THEN 1 ELSE 0 END AS tokens FROM (SELECT CAST(date_trunc('month', event_time) AS DATE) AS work_month, tokens_delta FROM event) GROUP BY 1")
def snk_6(t: Lake) -> DataFrame:
    """A table by month, of which the last ones are written a second time: those are replaced, the others stay."""
    monthly = t.event.groupBy(F.trunc("event_time", "month").alias("work_month")).agg(F.sum("tokens_delta").alias("tokens"))
    again = monthly.where("work_month >= date '1998-06-01'").withColumn("tokens", F.col("tokens") + 1)
    return sinks.rewritten(monthly, again, "work_month")


@query("snk_7", "SELECT user_code, work_date, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT user_code, CAST(signal_time AS DATE) AS work_date, tokens FROM activity) GROUP BY 1, 2")
def snk_7(t: Lake) -> DataFrame:
    """Daily rows first of some events, then of the days that the others touch, from all events of those days."""
    daily = lambda df: df.groupBy("user_code", F.to_date("signal_time").alias("work_date")).agg(F.sum("tokens").alias("tokens"))
    late = t.activity.where("event_type = 'purchase'")
    days = late.select(F.to_date("signal_time").alias("_day")).distinct()
    touched = t.activity.join(days, F.to_date("signal_time") == F.col("_day"), "left_semi")
    return sinks.rewritten(daily(t.activity.where("event_type <> 'purchase'")), daily(touched))


@query("snk_8", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk_8(t: Lake) -> DataFrame:
    """A stream pushed to a subscriber batch by batch; what it got."""
    return sinks.pushed(t.spark, t.folder)


@query("snk_10", "SELECT event_id FROM events")
def snk_10(t: Lake) -> DataFrame:
    """Rows spooled by a stream that stops and starts again from its checkpoint: each is there once."""
    return sinks.spooled(t.spark, t.folder)


@query("mat_8", "SELECT id, version, id % 2 = 1 AS changed FROM session")
def mat_8(t: Lake) -> DataFrame:
    """New versions written only where they differ."""
    stored = t.session.select("id", F.when(F.col("id") % 2 == 0, F.col("version")).alias("version"))
    return sinks.updated_if_changed(stored, t.session.select("id", "version"), "id", ["version"])


@query("mat_9", """SELECT s.id, CASE WHEN a.session_id IS NULL AND s.id % 5 = 0 THEN 'RUNNING' WHEN a.session_id IS NULL AND s.id % 5 = 1 THEN 'PENDING' WHEN a.session_id IS NULL AND s.id % 5 = 2 THEN 'FAILED' WHEN a.session_id IS NULL THEN 'NONE' WHEN s.total_messages - a.message_count > 5 THEN 'PENDING' ELSE 'DONE' END AS state
    FROM session s LEFT JOIN audit a ON a.session_id = s.id""")  # fmt: skip
def mat_9(t: Lake) -> DataFrame:
    """The audit's state after an event: a lease that runs keeps, one that ran out waits again, grown sessions wait again."""
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    half = F.make_dt_interval(mins=F.lit(30))
    rows = t.session.join(t.audit.select(F.col("session_id").alias("_a"), "message_count"), F.col("id") == F.col("_a"), "left")
    n = F.col("id") % 5
    rows = rows.select("id", F.when(F.col("_a").isNotNull(), "DONE").when(n < 2, "RUNNING").when(n == 2, "FAILED").otherwise("NONE").alias("state"), F.when(n == 0, now + half).when(n == 1, now - half).alias("lease_until"), F.coalesce(F.col("total_messages") - F.col("message_count") > 5, F.lit(False)).alias("grown"))
    return rows.select("id", states.audit_state(F.col("state"), F.col("lease_until"), F.col("grown"), now).alias("state"))


QUERIES, ORACLES = query.queries, query.oracles
