"""FLT, PRJ, SRT, SET and JN: filters, slices, orders, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.functions import text
from pulsegrid.operators import filters, joins
from pulsegrid.shared import stage

from .aggregates import ACTIVE, END, START
from .bindings import Lake
from .registry import Registry

query = Registry()
NOW = "2024-01-31 12:00:00"
IN = f"TIMESTAMP '{START}' AND {{c}} < TIMESTAMP '{END}'"


def half_open(c: str) -> str:
    return f"({c} >= TIMESTAMP '{START}' AND {c} < TIMESTAMP '{END}')"


NORM = "nullif(lower(regexp_replace(regexp_replace(trim({}), '(?i)(\\.git)+$', ''), '/+$', '')), '')"


# ---- filters


@query("flt_1", "SELECT id, user_code FROM session WHERE invalid_reason IS NULL")
def flt_1(t: Lake) -> DataFrame:
    return filters.valid(t.session).select("id", "user_code")


@query("flt_2", "SELECT id FROM session WHERE target_type IN ('urgent', 'high', 'medium')")
def flt_2(t: Lake) -> DataFrame:
    return filters.active_types(t.session, ACTIVE).select("id")


@query("flt_3", "SELECT id FROM session WHERE target_type IN ('high')")
def flt_3(t: Lake) -> DataFrame:
    return filters.active_types(t.session, set(ACTIVE) & {"high", "low"}).select("id")


@query("flt_4", f"SELECT id FROM event WHERE {half_open('event_time')}")
def flt_4(t: Lake) -> DataFrame:
    return t.event.where(filters.between("event_time", START, END)).select("id")


@query("flt_5", f"SELECT id FROM session WHERE {half_open('started_at')} OR {half_open('last_activity')}")
def flt_5(t: Lake) -> DataFrame:
    return t.session.where(filters.touches(START, END)).select("id")


@query("flt_6", f"SELECT id FROM session WHERE started_at <= TIMESTAMP '{END}' AND last_activity >= TIMESTAMP '{START}'")
def flt_6(t: Lake) -> DataFrame:
    return t.session.where(filters.overlaps(START, END)).select("id")


@query("flt_7", "SELECT project_name, count(*) AS n FROM session WHERE status <> 'idle' GROUP BY 1")
def flt_7(t: Lake) -> DataFrame:
    return t.session.where("status <> 'idle'").groupBy("project_name").agg(F.count(F.lit(1)).alias("n"))


@query("flt_8", f"SELECT id FROM session WHERE status <> 'idle' AND last_activity < TIMESTAMP '{END}' - INTERVAL 300 SECOND")
def flt_8(t: Lake) -> DataFrame:
    return t.session.where((F.col("status") != "idle") & (F.col("last_activity") < F.lit(END).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(300)))).select("id")


@query("flt_9", f"SELECT id, 'online' AS state FROM device WHERE status = 'ACTIVE' AND last_seen > TIMESTAMP '{NOW}' - INTERVAL 300 SECOND UNION ALL SELECT id, 'offline' FROM device WHERE status = 'ACTIVE' AND (last_seen IS NULL OR last_seen <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)")
def flt_9(t: Lake) -> DataFrame:
    return t.device.where(F.col("status") == "ACTIVE").select("id", F.when(filters.online(NOW), "online").otherwise("offline").alias("state"))


@query("flt_10", "SELECT id FROM event WHERE event_type IN ('SESSION_OPEN', 'TOKEN_DELTA', 'MESSAGE_DELTA')")
def flt_10(t: Lake) -> DataFrame:
    return t.event.where(filters.counted_events()).select("id")


@query("flt_11", "SELECT id FROM message WHERE lower(trim(role)) = 'user'")
def flt_11(t: Lake) -> DataFrame:
    return t.message.where(filters.role() == "user").select("id")


@query("flt_12", "SELECT id, tool_name FROM event WHERE starts_with(lower(tool_name), 'mcp__')")
def flt_12(t: Lake) -> DataFrame:
    return t.event.where(F.lower("tool_name").startswith("mcp__")).select("id", "tool_name")


@query("flt_13", "SELECT id FROM message WHERE coalesce(trim(slash_hits_json), '') NOT IN ('', '[]', 'null')")
def flt_13(t: Lake) -> DataFrame:
    return t.message.where(filters.has_hits()).select("id")


@query("flt_14", "SELECT id FROM commits WHERE user_code = 'u9'")
def flt_14(t: Lake) -> DataFrame:
    return t.commits.where(filters.optional("user_code", "u9") & filters.optional("project_name", None)).select("id")


@query("flt_15", "SELECT id FROM event WHERE tokens_delta <> 0 OR messages_delta <> 0 OR output_tokens_delta <> 0")
def flt_15(t: Lake) -> DataFrame:
    return t.event.where(filters.any_nonzero(["tokens_delta", "messages_delta", "output_tokens_delta"])).select("id")


AUDITED = f"""audited AS (SELECT s.id, s.total_messages, s.invalid_reason, a.session_id AS result, coalesce(x.state, 'NONE') IN ('NONE', 'PENDING') OR (x.state IN ('RUNNING', 'FAILED') AND (x.lease_until IS NULL OR x.lease_until < TIMESTAMP '{NOW}')) OR coalesce(x.reaudit, false)
      OR (x.state = 'DONE' AND a.session_id IS NOT NULL AND s.total_messages > a.message_count + 5) OR (x.state = 'DONE' AND a.session_id IS NULL) AS due,
      x.state = 'DONE' AND NOT coalesce(x.reaudit, false) AND a.session_id IS NOT NULL AND s.total_messages <= a.message_count + 5 AS stable
    FROM session s LEFT JOIN audit_state x ON x.session_id = s.id LEFT JOIN audit a ON a.session_id = s.id WHERE s.invalid_reason IS NULL AND s.total_messages > 0)"""


def audited(t: Lake) -> DataFrame:
    """Valid sessions with the state of their audit and its result, where there are any."""
    state = t.audit_state.select(F.col("session_id").alias("id"), "state", "lease_until", "reaudit")
    return filters.valid(t.session).join(state, "id", "left").join(t.audit.withColumnRenamed("session_id", "_a"), F.col("_a") == F.col("id"), "left")


@query("flt_16", f"WITH {AUDITED} SELECT id FROM audited WHERE due")
def flt_16(t: Lake) -> DataFrame:
    return audited(t).where(filters.needs_audit(NOW)).select("id")


@query("flt_17", """SELECT s.id, CASE WHEN a.session_id IS NULL THEN 'first' WHEN a.disagreement THEN 'flagged' WHEN s.total_messages > a.message_count + 5 THEN 'grown' ELSE 'skip' END AS decision
    FROM session s LEFT JOIN audit a ON a.session_id = s.id""")  # fmt: skip
def flt_17(t: Lake) -> DataFrame:
    found = t.session.join(t.audit.withColumnRenamed("session_id", "_a"), F.col("_a") == F.col("id"), "left")
    return found.select("id", F.when(F.col("_a").isNull(), "first").when(F.col("disagreement"), "flagged").when(F.col("total_messages") > F.col("message_count") + 5, "grown").otherwise("skip").alias("decision"))


@query("flt_18", f"SELECT count(*) > 0 AS found FROM (SELECT 1 FROM event WHERE event_time >= TIMESTAMP '{END}' LIMIT 1)")
def flt_18(t: Lake) -> DataFrame:
    return t.event.where(F.col("event_time") >= F.lit(END).cast("timestamp_ntz")).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("flt_19", """WITH m AS (SELECT id, role, CASE id % 6 WHEN 0 THEN '<local-command-stderr>x' WHEN 1 THEN '<command-name>x' WHEN 2 THEN ' <command-args>' WHEN 3 THEN 'Unknown command: /x' ELSE content_text END AS content FROM message)
    SELECT id FROM m WHERE NOT (lower(trim(role)) = 'user' AND regexp_matches(content, '^(<local-command-|<command-name>|<command-message>|<command-args>|Unknown command:)'))""")  # fmt: skip
def flt_19(t: Lake) -> DataFrame:
    """What is left without the echoes of local commands."""
    n = F.col("id") % 6
    content = F.when(n == 0, "<local-command-stderr>x").when(n == 1, "<command-name>x").when(n == 2, " <command-args>").when(n == 3, "Unknown command: /x").otherwise(F.col("content_text"))
    return t.message.withColumn("content", content).where(~((filters.role() == "user") & filters.local_command("content"))).select("id")


@query("flt_20", "SELECT id FROM commits WHERE author_email IN (SELECT 'dev' || c_custkey || '@x.org' FROM customer WHERE c_custkey < 20)")
def flt_20(t: Lake) -> DataFrame:
    allowed = t.customer.where("c_custkey < 20").select(F.concat(F.lit("dev"), "c_custkey", F.lit("@x.org")).alias("author_email"))
    return t.commits.join(allowed, "author_email", "left_semi").select("id")


@query("flt_21", "SELECT user_code FROM employee WHERE contains(lower(display_name), lower('#00000001'))")
def flt_21(t: Lake) -> DataFrame:
    return t.employee.where(F.lower("display_name").contains("#00000001")).select("user_code")


@query("flt_22", "SELECT id, user_code FROM session WHERE id > 500 ORDER BY id LIMIT 50")
def flt_22(t: Lake) -> DataFrame:
    return t.session.where("id > 500").orderBy("id").limit(50).select("id", "user_code")


@query("flt_23", f"""SELECT id, coalesce(CASE WHEN contains(trim(user_code), '@') AND NOT contains(trim(user_code), ' ') THEN trim(user_code) END, trim(git_email)) AS address FROM device WHERE hour(TIMESTAMP '{NOW}') BETWEEN 9 AND 17 AND status = 'ACTIVE' AND (last_seen IS NULL OR last_seen <= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)
    AND (last_email IS NULL OR last_email <= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR) AND ((contains(trim(user_code), '@') AND NOT contains(trim(user_code), ' ')) OR (contains(trim(git_email), '@') AND NOT contains(trim(git_email), ' ')))""")  # fmt: skip
def flt_23(t: Lake) -> DataFrame:
    """Devices whose user is due for a mail, and where it goes."""
    return t.device.where(filters.email_due(NOW)).select("id", filters.address().alias("address"))


@query("flt_24", "SELECT id FROM commit_file WHERE path = 'src/f9' OR old_path = 'old/f9'")
def flt_24(t: Lake) -> DataFrame:
    return t.commit_file.where("path = 'src/f9' or old_path = 'old/f9'").select("id")


@query("flt_25", f"SELECT id, event_time FROM event WHERE event_type = 'STATUS_CHANGE' AND event_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY event_time DESC, id LIMIT 20")
def flt_25(t: Lake) -> DataFrame:
    return t.event.where(filters.between_closed("event_time", START, END) & filters.optional("event_type", "STATUS_CHANGE")).orderBy(F.desc("event_time"), "id").limit(20).select("id", "event_time")


@query("flt_26", f"SELECT id FROM session WHERE user_code = 'u7' AND last_activity >= TIMESTAMP '{START}'")
def flt_26(t: Lake) -> DataFrame:
    return t.session.where((F.col("user_code") == "u7") & (F.col("last_activity") >= F.lit(START).cast("timestamp_ntz"))).select("id")


@query("flt_27", "SELECT agent_id, max(struct_pack(a := last_activity, b := id)).b AS id FROM session GROUP BY agent_id")
def flt_27(t: Lake) -> DataFrame:
    return t.session.groupBy("agent_id").agg(F.max(F.struct("last_activity", "id")).alias("m")).select("agent_id", "m.id")


@query("flt_27_events", "SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM event) WHERE n <= 100")
def flt_27_events(t: Lake) -> DataFrame:
    """The newest hundred events of each session."""
    newest = W.partitionBy("session_id").orderBy(F.desc("id"))
    return t.event.select("session_id", "id", F.row_number().over(newest).alias("n")).where("n <= 100").select("session_id", "id")


@query("flt_28", f"SELECT id FROM session WHERE ({half_open('started_at')} OR {half_open('last_activity')}) AND user_code = 'u7'")
def flt_28(t: Lake) -> DataFrame:
    return t.session.where(filters.touches(START, END) & filters.optional("user_code", "u7")).select("id")


@query("flt_29", "SELECT id FROM event WHERE contains(tool_name, 'mcp__')")
def flt_29(t: Lake) -> DataFrame:
    return t.event.where(F.col("tool_name").contains("mcp__")).select("id")


@query("flt_30", f"SELECT id, session_id, seq FROM message WHERE lower(trim(role)) IN ('user', 'assistant') AND {half_open('message_time')}")
def flt_30(t: Lake) -> DataFrame:
    return t.message.where(filters.role().isin("user", "assistant") & filters.between("message_time", START, END)).select("id", "session_id", "seq")


@query("flt_30_all", f"SELECT id, session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(conversation_order, 2147483647) DESC, message_time DESC, seq DESC, id) AS place FROM message WHERE lower(trim(role)) IN ('user', 'assistant') AND {half_open('message_time')}")
def flt_30_all(t: Lake) -> DataFrame:
    """The messages of every session in the window, in order."""
    return in_order(t.message.where(filters.role().isin("user", "assistant") & filters.between("message_time", START, END)))


@query("flt_32", "SELECT f.id, f.path FROM commit_file f JOIN commits c ON f.commit_id = c.id WHERE c.commit_hash = 'hash12' OR c.commit_hash = 'hash30'")
def flt_32(t: Lake) -> DataFrame:
    chosen = t.commits.where(F.col("commit_hash").isin("hash12", "hash30")).select(F.col("id").alias("commit_id"))
    return t.commit_file.join(chosen, "commit_id", "left_semi").select("id", "path")


# ---- slices and orders


@query("prj_5", "SELECT id, CASE WHEN lower(trim(role)) IN ('tool', 'assistant') THEN slash_hits_json END AS json, CASE WHEN slash_hits_json IS NULL THEN content_text END AS body FROM message")
def prj_5(t: Lake) -> DataFrame:
    return t.message.select("id", F.when(filters.role().isin("tool", "assistant"), F.col("slash_hits_json")).alias("json"), F.when(F.col("slash_hits_json").isNull(), F.col("content_text")).alias("body"))


@query("prj_6", "SELECT m.user_code, m.session_id, m.slash_hits_json, s.target_type FROM message m JOIN session s ON m.session_id = s.id WHERE coalesce(m.slash_command_count, 0) + coalesce(m.slash_skill_count, 0) > 0")
def prj_6(t: Lake) -> DataFrame:
    counted = t.message.where("coalesce(slash_command_count, 0) + coalesce(slash_skill_count, 0) > 0")
    return counted.join(t.session.select(F.col("id").alias("session_id"), "target_type"), "session_id").select("user_code", "session_id", "slash_hits_json", "target_type")


def in_order(messages: DataFrame) -> DataFrame:
    newest = W.partitionBy("session_id").orderBy(F.coalesce("conversation_order", F.lit(2147483647)).desc(), F.desc("message_time"), F.desc("seq"), "id")
    return messages.select("id", "session_id", "seq", F.row_number().over(newest).cast("long").alias("place"))


ORDERED = "SELECT id, session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(conversation_order, 2147483647) DESC, message_time DESC, seq DESC, id) AS place FROM message"


@query("srt_3", ORDERED)
@query("srt_3_all", ORDERED)
def srt_3(t: Lake) -> DataFrame:
    """The message order of every session."""
    return in_order(t.message)


@query("srt_4", "SELECT id, last_seen FROM device ORDER BY last_seen ASC NULLS FIRST, id LIMIT 30")
def srt_4(t: Lake) -> DataFrame:
    return t.device.orderBy(F.asc_nulls_first("last_seen"), "id").limit(30).select("id", "last_seen")


@query("srt_5", "SELECT id, (SELECT count(*) FROM session) AS total FROM session ORDER BY id LIMIT 20 OFFSET 40")
def srt_5(t: Lake) -> DataFrame:
    page = t.session.orderBy("id").offset(40).limit(20).select("id")
    return page.join(F.broadcast(t.session.agg(F.count(F.lit(1)).alias("total"))), how="cross")  # one row


@query("srt_10", "SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_time DESC, id DESC) AS n FROM message) WHERE n <= 2")
def srt_10(t: Lake) -> DataFrame:
    recent = W.partitionBy("session_id").orderBy(F.desc("message_time"), F.desc("id"))
    return t.message.withColumn("n", F.row_number().over(recent)).where("n <= 2").select("id", "session_id")


@query("srt_13", """WITH ranked AS (SELECT id, user_code, row_number() OVER (PARTITION BY user_code ORDER BY message_time, id) - 1 AS i, count(*) OVER (PARTITION BY user_code) AS n FROM message)
    SELECT id, user_code FROM ranked WHERE n <= 200 OR i < 50 OR i >= n - 50 OR (i - 50) % greatest(1, (n - 100) // 20) = 0""")  # fmt: skip
def srt_13(t: Lake) -> DataFrame:
    """Long sequences: first 50, last 50, and every (n - 100) / 20th between."""
    by = W.partitionBy("user_code")
    ranked = t.message.select("id", "user_code", (F.row_number().over(by.orderBy("message_time", "id")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    return ranked.where("n <= 200 or i < 50 or i >= n - 50 or (i - 50) % greatest(1, (n - 100) div 20) = 0").select("id", "user_code")


@query("srt_14", "SELECT id, greatest(input_tokens, output_tokens) AS most FROM session ORDER BY most DESC, id LIMIT 50")
def srt_14(t: Lake) -> DataFrame:
    return t.session.select("id", F.greatest("input_tokens", "output_tokens").alias("most")).orderBy(F.desc("most"), "id").limit(50)


# ---- set operations


@query("set_1", "SELECT session_id, 'event:' || id AS ref FROM event UNION ALL SELECT session_id, 'message:' || id FROM message")
def set_1(t: Lake) -> DataFrame:
    return t.event.select("session_id", F.concat(F.lit("event:"), "id").alias("ref")).unionByName(t.message.select("session_id", F.concat(F.lit("message:"), "id").alias("ref")))


@query("set_2", f"SELECT user_code FROM event WHERE {half_open('event_time')} UNION SELECT user_code FROM message WHERE {half_open('message_time')}")
def set_2(t: Lake) -> DataFrame:
    return t.event.where(filters.between("event_time", START, END)).select("user_code").union(t.message.where(filters.between("message_time", START, END)).select("user_code")).distinct()


@query("set_3", "SELECT session_id, event_time AS signal_time FROM event UNION ALL SELECT session_id, message_time FROM message")
def set_3(t: Lake) -> DataFrame:
    return t.event.select("session_id", F.col("event_time").alias("signal_time")).unionByName(t.message.select("session_id", F.col("message_time").alias("signal_time")))


@query("set_4", "SELECT DISTINCT target_type FROM session INTERSECT SELECT unnest(['urgent', 'high', 'none'])")
def set_4(t: Lake) -> DataFrame:
    return t.session.select("target_type").intersect(t.session.sparkSession.createDataFrame([("urgent",), ("high",), ("none",)], "target_type string"))


@query("set_5", """WITH seen AS (SELECT DISTINCT session_id FROM event), kept AS (SELECT DISTINCT session_id FROM message WHERE input_tokens > 20), child AS (SELECT id, id // 10 AS parent FROM session WHERE id >= 10)
    SELECT session_id FROM seen WHERE session_id NOT IN (SELECT session_id FROM kept) UNION SELECT child.id FROM child WHERE parent IN (SELECT session_id FROM kept) AND id NOT IN (SELECT session_id FROM kept)""")  # fmt: skip
def set_5(t: Lake) -> DataFrame:
    """Suppressed sessions: those seen and not kept, and the declared children of kept ones that are not kept."""
    kept = t.message.where("input_tokens > 20").select("session_id")
    children = t.session.where("id >= 10").select(F.col("id").alias("session_id"), F.expr("id div 10").alias("parent"))
    declared = children.join(kept.select(F.col("session_id").alias("parent")), "parent", "left_semi").select("session_id")
    return joins.missing(t.event.select("session_id").union(declared).distinct(), kept, ["session_id"])


@query("set_6", "SELECT 'session' AS name, count(*) AS n FROM session WHERE user_code = 'u7' UNION ALL SELECT 'event', count(*) FROM event WHERE user_code = 'u7' UNION ALL SELECT 'message', count(*) FROM message WHERE user_code = 'u7'")
def set_6(t: Lake) -> DataFrame:
    parts = [df.where("user_code = 'u7'").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("session", t.session), ("event", t.event), ("message", t.message))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- joins


@query("jn_1", "SELECT e.id, s.project_name, s.model FROM event e JOIN session s ON e.session_id = s.id WHERE s.invalid_reason IS NULL")
def jn_1(t: Lake) -> DataFrame:
    return t.event.join(filters.valid(t.session).select(F.col("id").alias("session_id"), "project_name", "model"), "session_id").select("id", "project_name", "model")


@query("jn_2", "SELECT m.id, s.project_name FROM message m JOIN session s ON m.session_id = s.id WHERE s.invalid_reason IS NULL")
def jn_2(t: Lake) -> DataFrame:
    return t.message.join(filters.valid(t.session).select(F.col("id").alias("session_id"), "project_name"), "session_id").select("id", "project_name")


@query("jn_3", "SELECT s.id, a.difficulty, a.outcome FROM session s LEFT JOIN audit a ON a.session_id = s.id")
def jn_3(t: Lake) -> DataFrame:
    return t.session.select("id").join(t.audit.select(F.col("session_id").alias("id"), "difficulty", "outcome"), "id", "left")


@query("jn_4", "SELECT count(*) AS n FROM session s JOIN audit a ON a.session_id = s.id WHERE s.total_messages - a.message_count <= 5 AND s.invalid_reason IS NULL")
def jn_4(t: Lake) -> DataFrame:
    found = filters.valid(t.session).join(t.audit.select(F.col("session_id").alias("id"), "message_count"), "id")
    return found.where("total_messages - message_count <= 5").agg(F.count(F.lit(1)).alias("n"))


@query("jn_6", f"""SELECT c.id FROM commits c WHERE EXISTS (SELECT 1 FROM session s WHERE s.user_code = c.user_code AND s.invalid_reason IS NULL AND {NORM.format('s.repo_url')} = {NORM.format('c.repo_url')}
    AND c.commit_time BETWEEN s.started_at - INTERVAL 30 MINUTE AND s.last_activity + INTERVAL 30 MINUTE)""")  # fmt: skip
def jn_6(t: Lake) -> DataFrame:
    sessions = filters.valid(t.session).select(F.col("user_code").alias("_user"), text.norm_repo(F.col("repo_url")).alias("_repo"), "started_at", "last_activity")
    points = t.commits.select("id", "user_code", "commit_time", text.norm_repo(F.col("repo_url")).alias("repo"))
    half = joins.minutes(30)
    return joins.band(points, sessions, {"user_code": "_user", "repo": "_repo"}, "commit_time", F.col("started_at") - half, F.col("last_activity") + half, "left_semi").select("id")


@query("jn_7", "SELECT id FROM commits c WHERE path_stats_json IS NOT NULL AND NOT EXISTS (SELECT 1 FROM commit_file f WHERE f.commit_id = c.id)")
def jn_7(t: Lake) -> DataFrame:
    return joins.missing(t.commits.where("path_stats_json is not null").select("id"), t.commit_file.select(F.col("commit_id").alias("id")), ["id"])


@query("jn_8", "SELECT f.id FROM commit_file f LEFT JOIN commits c ON f.commit_id = c.id WHERE c.id IS NULL")
def jn_8(t: Lake) -> DataFrame:
    return joins.missing(t.commit_file.select("id", "commit_id"), t.commits.select(F.col("id").alias("commit_id")), ["commit_id"]).select("id")


@query("jn_9", f"SELECT DISTINCT f.commit_id FROM commit_file f JOIN commits c ON f.commit_id = c.id WHERE f.has_patch AND c.commit_time < TIMESTAMP '{START}' ORDER BY 1 LIMIT 100")
def jn_9(t: Lake) -> DataFrame:
    old = t.commits.where(F.col("commit_time") < F.lit(START).cast("timestamp_ntz")).select(F.col("id").alias("commit_id"))
    return t.commit_file.where("has_patch").join(old, "commit_id").select("commit_id").distinct().orderBy("commit_id").limit(100)


@query("jn_10", "SELECT agent_id, id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY end_time DESC, id) AS n FROM work WHERE status = 'OPEN') WHERE n = 1")
def jn_10(t: Lake) -> DataFrame:
    return joins.latest(t.work.where("status = 'OPEN'"), ["agent_id"], F.desc("end_time"), F.col("id")).select("agent_id", "id")


@query("jn_12", """SELECT DISTINCT c.id FROM commits c JOIN session s ON s.user_code = c.user_code JOIN audit a ON a.session_id = s.id
    WHERE a.difficulty >= 4 AND s.last_activity >= c.commit_time - INTERVAL 30 MINUTE AND s.started_at <= c.commit_time + INTERVAL 5 MINUTE AND (s.repo_url IS NULL OR lower(s.repo_url) = lower(c.repo_url))""")  # fmt: skip
def jn_12(t: Lake) -> DataFrame:
    hard = t.session.join(t.audit.where("difficulty >= 4").select(F.col("session_id").alias("id")), "id", "left_semi")
    sides = hard.select(F.col("user_code").alias("_user"), F.lower("repo_url").alias("_repo"), "started_at", "last_activity")
    found = joins.band(t.commits, sides, {"user_code": "_user"}, "commit_time", F.col("started_at") - joins.minutes(5), F.col("last_activity") + joins.minutes(30))
    return found.where(F.col("_repo").isNull() | (F.col("_repo") == F.lower("repo_url"))).select("id").distinct()


@query("jn_13", """SELECT DISTINCT a.id FROM commits a JOIN commits b ON a.user_code = b.user_code AND lower(a.repo_url) IS NOT DISTINCT FROM lower(b.repo_url) AND a.commit_hash <> b.commit_hash
    WHERE regexp_matches(b.message_subject, '(?i)^\\s*revert(\\s|:|")') AND b.commit_time > a.commit_time AND b.commit_time <= a.commit_time + INTERVAL 7 DAY""")  # fmt: skip
def jn_13(t: Lake) -> DataFrame:
    """Commits that a later one of the same repository, within a week, reverts."""
    side = F.coalesce(F.lower("repo_url"), F.lit("\0"))
    reverts = t.commits.where(text.is_revert(F.col("message_subject"))).select(F.col("user_code"), side.alias("_repo"), F.col("commit_hash").alias("_hash"), F.col("commit_time").alias("_time"))
    commits = t.commits.select("id", F.col("user_code").alias("_user"), side.alias("_own"), "commit_hash", "commit_time")
    found = joins.band(reverts, commits, {"user_code": "_user", "_repo": "_own"}, "_time", F.col("commit_time"), F.col("commit_time") + F.make_dt_interval(days=F.lit(7)), seconds=7 * 86_400)
    return found.where("_time > commit_time and _hash <> commit_hash").select("id").distinct()


@query("jn_14", """SELECT DISTINCT s.id FROM session s JOIN commits c ON s.user_code = c.user_code
    WHERE c.commit_time BETWEEN s.last_activity - INTERVAL 30 MINUTE AND s.last_activity + INTERVAL 30 MINUTE AND (s.repo_url IS NULL OR lower(s.repo_url) = lower(c.repo_url))""")  # fmt: skip
def jn_14(t: Lake) -> DataFrame:
    sides = t.session.select(F.col("id").alias("_id"), F.col("user_code").alias("_user"), F.lower("repo_url").alias("_repo"), "last_activity")
    found = joins.band(t.commits, sides, {"user_code": "_user"}, "commit_time", F.col("last_activity") - joins.minutes(30), F.col("last_activity") + joins.minutes(30))
    return found.where(F.col("_repo").isNull() | (F.col("_repo") == F.lower("repo_url"))).select(F.col("_id").alias("id")).distinct()


@query("jn_15", "SELECT DISTINCT path FROM commit_file f WHERE NOT EXISTS (SELECT 1 FROM commit_file g JOIN commits c ON g.commit_id = c.id WHERE g.path = f.path AND c.lines_added > 495)")
def jn_15(t: Lake) -> DataFrame:
    """Content that no linked row refers to any more."""
    linked = t.commit_file.join(t.commits.where("lines_added > 495").select(F.col("id").alias("commit_id")), "commit_id").select("path")
    return joins.missing(t.commit_file.select("path").distinct(), linked, ["path"])


@query("jn_16", """SELECT e.user_code, coalesce(s.n, 0) AS sessions, coalesce(c.n, 0) AS commits FROM employee e
    LEFT JOIN (SELECT user_code, count(*) AS n FROM session GROUP BY 1) s ON s.user_code = e.user_code LEFT JOIN (SELECT user_code, count(*) AS n FROM commits GROUP BY 1) c ON c.user_code = e.user_code""")  # fmt: skip
def jn_16(t: Lake) -> DataFrame:
    sessions, made = [df.groupBy("user_code").agg(F.count(F.lit(1)).alias(n)) for df, n in ((t.session, "sessions"), (t.commits, "commits"))]
    return t.employee.select("user_code").join(sessions, "user_code", "left").join(made, "user_code", "left").fillna(0, ["sessions", "commits"])


@query("jn_17", """WITH top AS (SELECT user_code, CAST(sum(tokens_delta) AS BIGINT) AS tokens FROM event GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT top.user_code, tokens, coalesce(u, 0) AS user_messages, coalesce(i, tokens) AS input_tokens FROM top LEFT JOIN (SELECT user_code, count(*) AS u FROM message WHERE lower(trim(role)) = 'user' GROUP BY 1) m USING (user_code)
    LEFT JOIN (SELECT user_code, CAST(sum(input_tokens) AS BIGINT) AS i FROM session WHERE invalid_reason IS NULL GROUP BY 1) s USING (user_code)""")  # fmt: skip
def jn_17(t: Lake) -> DataFrame:
    top = t.event.groupBy("user_code").agg(F.sum("tokens_delta").alias("tokens")).orderBy(F.desc("tokens"), "user_code").limit(5)
    said = t.message.where(filters.role() == "user").groupBy("user_code").agg(F.count(F.lit(1)).alias("u"))
    used = filters.valid(t.session).groupBy("user_code").agg(F.sum("input_tokens").alias("i"))
    return top.join(said, "user_code", "left").join(used, "user_code", "left").select("user_code", "tokens", F.coalesce("u", F.lit(0)).alias("user_messages"), F.coalesce("i", "tokens").alias("input_tokens"))


@query("jn_18", """WITH p AS (SELECT project_name, max(repo_url) AS repo_url, count(*) AS sessions FROM session WHERE project_name IS NOT NULL GROUP BY 1), c AS (SELECT lower(repo_url) AS r, count(*) AS n FROM commits GROUP BY 1)
    SELECT project_name, sessions, coalesce(n, 0) AS commits FROM p LEFT JOIN c ON lower(p.repo_url) = c.r""")  # fmt: skip
def jn_18(t: Lake) -> DataFrame:
    projects = t.session.where("project_name is not null").groupBy("project_name").agg(F.max("repo_url").alias("repo_url"), F.count(F.lit(1)).alias("sessions"))
    made = t.commits.groupBy(F.lower("repo_url").alias("r")).agg(F.count(F.lit(1)).alias("commits"))
    return projects.join(made, F.lower("repo_url") == F.col("r"), "left").select("project_name", "sessions", F.coalesce("commits", F.lit(0)).alias("commits"))


@query("jn_19", f"""WITH on_ AS (SELECT agent_id, max(last_seen) AS seen FROM device WHERE status = 'ACTIVE' AND last_seen > TIMESTAMP '{NOW}' - INTERVAL 300 SECOND GROUP BY 1),
    live AS (SELECT agent_id, target_type, id, row_number() OVER (PARTITION BY agent_id, target_type ORDER BY last_activity DESC, id) AS n FROM session WHERE status <> 'idle')
    SELECT on_.agent_id, live.target_type, live.id FROM on_ LEFT JOIN live ON live.agent_id = on_.agent_id AND n = 1""")  # fmt: skip
def jn_19(t: Lake) -> DataFrame:
    online = t.device.where(filters.online(NOW)).select("agent_id").distinct()
    live = joins.latest(t.session.where("status <> 'idle'"), ["agent_id", "target_type"], F.desc("last_activity"), F.col("id"))
    return online.join(live.select("agent_id", "target_type", "id"), "agent_id", "left")


@query("jn_21", """SELECT child.id, parent.external_session_id AS parent FROM (SELECT id, 'ext-' || (id - id % 10) || ':agent' AS ref FROM session) child
    JOIN session parent ON parent.external_session_id = split_part(child.ref, ':', 1)""")  # fmt: skip
def jn_21(t: Lake) -> DataFrame:
    child = t.session.select("id", F.concat(F.lit("ext-"), F.col("id") - F.col("id") % 10, F.lit(":agent")).alias("ref"))
    return child.withColumn("parent", F.substring_index("ref", ":", 1)).join(t.session.select(F.col("external_session_id").alias("parent")), "parent").select("id", "parent")


@query("jn_22", "SELECT id FROM session s WHERE EXISTS (SELECT 1 FROM message m WHERE m.session_id = s.id AND m.role = 'tool') AND NOT EXISTS (SELECT 1 FROM message m WHERE m.session_id = s.id AND lower(trim(m.role)) = 'user' AND m.seq > 4)")
def jn_22(t: Lake) -> DataFrame:
    tool, user = t.message.where("role = 'tool'"), t.message.where((filters.role() == "user") & (F.col("seq") > 4))
    with_tool = t.session.select("id").join(tool.select(F.col("session_id").alias("id")), "id", "left_semi")
    return joins.missing(with_tool, user.select(F.col("session_id").alias("id")), ["id"])


@query("jn_23", """WITH top AS (SELECT id, input_tokens FROM session ORDER BY input_tokens DESC, id LIMIT 50), e AS (SELECT session_id, CAST(sum(tokens_delta) AS BIGINT) AS d FROM event GROUP BY 1), m AS (SELECT session_id, count(*) AS n FROM message GROUP BY 1)
    SELECT top.id, input_tokens, d AS event_tokens, n AS messages FROM top LEFT JOIN e ON e.session_id = top.id LEFT JOIN m ON m.session_id = top.id""")  # fmt: skip
def jn_23(t: Lake) -> DataFrame:
    top = t.session.select("id", "input_tokens").orderBy(F.desc("input_tokens"), "id").limit(50)
    wanted = top.select(F.col("id").alias("session_id"))
    events = t.event.join(wanted, "session_id", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.sum("tokens_delta").alias("event_tokens"))
    said = t.message.join(wanted, "session_id", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    return top.join(events, "id", "left").join(said, "id", "left")


@query("jn_24", """WITH summary AS (SELECT user_code, CAST(event_time AS DATE) AS work_date, CAST(sum(tokens_delta) AS BIGINT) AS stored FROM event WHERE event_type <> 'TOOL_CALL' GROUP BY 1, 2), again AS (SELECT user_code, CAST(event_time AS DATE) AS work_date, CAST(sum(tokens_delta) AS BIGINT) AS counted FROM event GROUP BY 1, 2)
    SELECT user_code, work_date, stored, counted FROM summary JOIN again USING (user_code, work_date) WHERE stored <> counted""")  # fmt: skip
def jn_24(t: Lake) -> DataFrame:
    """A summary table against the same days counted anew, where they differ."""
    by = ["user_code", "work_date"]
    daily = lambda df, name: df.groupBy("user_code", F.to_date("event_time").alias("work_date")).agg(F.sum("tokens_delta").alias(name))
    summary = stage(daily(t.event.where("event_type <> 'TOOL_CALL'"), "stored"), "summary")
    return summary.join(daily(t.event, "counted"), by).where("stored <> counted")


@query("jn_25", """WITH RECURSIVE link AS (SELECT id AS child, id // 10 AS parent FROM session WHERE id >= 10), up AS (SELECT child, parent FROM link UNION ALL SELECT up.child, link.parent FROM up JOIN link ON up.parent = link.child)
    SELECT child, min(parent) AS root FROM up GROUP BY child""")  # fmt: skip
def jn_25(t: Lake) -> DataFrame:
    return joins.roots(t.session.where("id >= 10").select(F.col("id").alias("child"), F.expr("id div 10").alias("parent")))


@query("jn_26", "SELECT s.id, CASE WHEN a.session_id IS NULL THEN 'NONE' ELSE 'DONE' END AS audit_status, s.version + CASE WHEN a.session_id IS NULL THEN 0 ELSE 1 END AS version FROM session s LEFT JOIN audit a ON a.session_id = s.id")
def jn_26(t: Lake) -> DataFrame:
    found = t.session.select("id", "version").join(t.audit.select(F.col("session_id").alias("id"), F.lit(1).alias("done")), "id", "left")
    return found.select("id", F.when(F.col("done").isNull(), "NONE").otherwise("DONE").alias("audit_status"), (F.col("version") + F.coalesce("done", F.lit(0))).alias("version"))


QUERIES, ORACLES = query.queries, query.oracles
