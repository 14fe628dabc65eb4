"""WIN, JSON hits, attribution and the summary tables built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import filters, hits, sequences

from .bindings import Lake
from .materialised import built
from .registry import Registry

query = Registry()
BY = ["user_code", "session_id"]

# ---- what several queries share, as SQL for DuckDB

GAPS = """gaps AS (SELECT user_code, session_id, day, b AS s, least(b + least(t // 1000 - b // 1000, 300000) * 1000, epoch_us(CAST(day + 1 AS TIMESTAMP))) AS e
    FROM (SELECT user_code, session_id, CAST(signal_time AS DATE) AS day, epoch_us(signal_time) AS t, lag(epoch_us(signal_time)) OVER (PARTITION BY user_code, session_id, CAST(signal_time AS DATE) ORDER BY signal_time) AS b FROM activity)
    WHERE b IS NOT NULL AND t // 1000 - b // 1000 > 0 AND t // 1000 - b // 1000 <= 1800000)"""
ACTIVE = "active AS (SELECT user_code, day, CAST(sum((e - s) // 1000000) AS BIGINT) AS active_seconds FROM gaps GROUP BY ALL)"
UNION = """islands AS (SELECT *, sum(CASE WHEN s > coalesce(reach, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY user_code, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, max(e) OVER (PARTITION BY user_code, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_code, day, s // 1000000 AS s, e // 1000000 AS e FROM gaps))),
    united AS (SELECT user_code, day, CAST(sum(n) AS BIGINT) AS union_seconds FROM (SELECT user_code, day, max(e) - min(s) AS n FROM islands GROUP BY user_code, day, island) GROUP BY ALL)"""
THINKING = """edges AS (SELECT user_code, session_id, day, t, st, lead(t) OVER w2 AS nxt FROM (SELECT *, coalesce(lag(st) OVER w, false) AS was FROM (SELECT user_code, session_id, CAST(signal_time AS DATE) AS day, signal_time AS t, status = 'thinking' AS st, id FROM activity)
      WINDOW w AS (PARTITION BY user_code, session_id, day ORDER BY t, id)) WHERE st <> was WINDOW w2 AS (PARTITION BY user_code, session_id, day ORDER BY t, id)),
    thinking AS (SELECT user_code, day, CAST(sum((epoch_us(coalesce(nxt, CAST(day + 1 AS TIMESTAMP))) - epoch_us(t)) // 1000000) AS BIGINT) AS thinking_seconds FROM edges WHERE st GROUP BY ALL)"""
RESPONSE = """msg AS (SELECT user_code, session_id, CAST(signal_time AS DATE) AS day, signal_time AS t, id, lower(trim(role)) AS r FROM activity),
    firsts AS (SELECT user_code, session_id, day, min(id) FILTER (r = 'user') AS u FROM msg GROUP BY ALL),
    answers AS (SELECT m.user_code, m.session_id, m.day, min(m.id) AS a FROM msg m JOIN firsts f USING (user_code, session_id, day) WHERE m.r = 'assistant' AND m.id > f.u GROUP BY ALL),
    response AS (SELECT f.user_code, f.session_id, f.day, CASE WHEN a IS NULL OR u IS NULL THEN -1 ELSE greatest(0, (epoch_us(ma.t) - epoch_us(mu.t)) // 1000) END AS first_response_ms
      FROM firsts f LEFT JOIN answers n USING (user_code, session_id, day) LEFT JOIN msg mu ON mu.id = f.u LEFT JOIN msg ma ON ma.id = n.a)"""
RETRIES = """retry AS (SELECT user_code, session_id, day, CAST(sum(CASE WHEN r = 'user' AND p = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS retries FROM (SELECT *, lag(r) OVER (PARTITION BY user_code, session_id, day ORDER BY id) AS p
      FROM (SELECT user_code, session_id, CAST(signal_time AS DATE) AS day, id, lower(trim(role)) AS r FROM activity) WHERE r IN ('user', 'assistant')) GROUP BY ALL)"""


@query("win_1", f"WITH {GAPS} SELECT user_code, session_id, day, CAST(sum((e - s) // 1000000) AS BIGINT) AS active_seconds FROM gaps GROUP BY ALL")
def win_1(t: Lake) -> DataFrame:
    return sequences.active_seconds(sequences.activity_intervals(t.activity, BY), BY)


@query("win_2", f"WITH {GAPS}, {UNION} SELECT * FROM united")
def win_2(t: Lake) -> DataFrame:
    return sequences.union_seconds(sequences.activity_intervals(t.activity, BY), ["user_code"])


@query("win_3", f"WITH {THINKING} SELECT * FROM thinking")
def win_3(t: Lake) -> DataFrame:
    return sequences.state_seconds(t.activity, BY, "thinking").groupBy("user_code", "day").agg(F.sum("thinking_seconds").alias("thinking_seconds"))


@query("win_4", f"WITH {RESPONSE} SELECT * FROM response")
def win_4(t: Lake) -> DataFrame:
    return sequences.first_response(t.activity, BY)


@query("win_4_average", f"WITH {RESPONSE} SELECT user_code, day, CAST(sum(first_response_ms) AS BIGINT) // count(*) AS average_ms FROM response WHERE first_response_ms > 0 AND first_response_ms < 1800000 GROUP BY ALL")
def win_4_average(t: Lake) -> DataFrame:
    return sequences.first_response(t.activity, BY).where("first_response_ms > 0 and first_response_ms < 1800000").groupBy("user_code", "day").agg(F.expr("sum(first_response_ms) div count(*)").alias("average_ms"))


@query("win_5", f"WITH {RETRIES} SELECT * FROM retry")
def win_5(t: Lake) -> DataFrame:
    return sequences.retries(t.activity, BY)


@query("win_6", """SELECT day, user_code, count(DISTINCT session_id) AS sessions, CAST(sum(tool) AS BIGINT) AS tool_calls FROM (
      SELECT CAST(event_time AS DATE) AS day, user_code, session_id, CASE WHEN event_type = 'TOOL_CALL' THEN 1 ELSE 0 END AS tool FROM event
      UNION ALL SELECT CAST(message_time AS DATE), user_code, session_id, 0 FROM message) GROUP BY 1, 2""")  # fmt: skip
def win_6(t: Lake) -> DataFrame:
    events = t.event.select(F.to_date("event_time").alias("day"), "user_code", "session_id", (F.col("event_type") == "TOOL_CALL").cast("int").alias("tool"))
    rows = events.unionByName(t.message.select(F.to_date("message_time").alias("day"), "user_code", "session_id", F.lit(0).alias("tool")))
    return rows.groupBy("day", "user_code").agg(F.count_distinct("session_id").alias("sessions"), F.sum("tool").alias("tool_calls"))


@query("win_7", """WITH m AS (SELECT user_code, model, CAST(sum(CASE WHEN input_tokens BETWEEN 0 AND 2000000000 AND output_tokens BETWEEN 0 AND 2000000000 THEN input_tokens + output_tokens ELSE 0 END) AS BIGINT) AS tokens FROM session WHERE model IS NOT NULL GROUP BY 1, 2)
    SELECT user_code, model, tokens, place FROM (SELECT *, row_number() OVER (PARTITION BY user_code ORDER BY tokens DESC, model) AS place FROM m WHERE tokens > 0) WHERE place <= 3""")  # fmt: skip
def win_7(t: Lake) -> DataFrame:
    sane = F.expr("case when input_tokens between 0 and 2000000000 and output_tokens between 0 and 2000000000 then input_tokens + output_tokens else 0 end")
    totals = t.session.where("model is not null").groupBy("user_code", "model").agg(F.sum(sane).alias("tokens"))
    return sequences.top_values(totals, ["user_code"], "model", "tokens").withColumn("place", F.col("place").cast("long"))


@query("win_8")
def win_8(t: Lake) -> DataFrame:
    """Skills that were read and then carried out by a tool that does more than read, as the messages' parts tell."""
    reads = F.when((filters.role() == "assistant") & F.col("content_text").contains("SKILL.md"), F.array(F.concat(F.lit("/skills/"), F.regexp_extract("content_text", r"skills/([^/]+)/SKILL\.md", 1)))).otherwise(F.array().cast("array<string>"))
    return sequences.skill_uses(t.message.select("session_id", "seq", "role", reads.alias("reads"), hits.carries_out(F.col("content_parts_json")).alias("executes")))


@query("win_11", """WITH r AS (SELECT agent_id, id, epoch_us(start_time) // 1000000 AS t, status = 'OPEN' AS busy FROM work), g AS (SELECT *, t - lag(t) OVER (PARTITION BY agent_id ORDER BY t, id) AS gap FROM r),
    s AS (SELECT *, sum(CASE WHEN gap > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS span, CASE WHEN gap > 0 AND gap <= 180 THEN least(gap, 120) ELSE 0 END AS credit FROM g)
    SELECT agent_id, CAST(span AS BIGINT) AS span, min(t) AS start_s, max(t) AS end_s, CAST(sum(credit) AS BIGINT) AS duration_seconds, CAST(sum(CASE WHEN busy THEN credit ELSE 0 END) AS BIGINT) AS active_seconds FROM s GROUP BY 1, 2""")  # fmt: skip
def win_11(t: Lake) -> DataFrame:
    return sequences.work_spans(t.work.withColumn("busy", F.col("status") == "OPEN"), "agent_id", "start_time", "busy")


@query("win_13", "SELECT id, greatest(tokens - lag(tokens, 1, 0) OVER (PARTITION BY user_code ORDER BY id), 0) AS delta FROM activity")
def win_13(t: Lake) -> DataFrame:
    return sequences.deltas(t.activity, ["user_code"], "tokens", "id").select("id", "delta")


@query("win_14", """SELECT m.id, CAST(floor(epoch_us(s.started_at) + (epoch_us(s.last_activity) - epoch_us(s.started_at)) * CAST(row_number() OVER w - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY m.session_id) - 1, 1)) AS BIGINT) AS at_us
    FROM message m JOIN session s ON m.session_id = s.id WINDOW w AS (PARTITION BY m.session_id ORDER BY m.id)""")  # fmt: skip
def win_14(t: Lake) -> DataFrame:
    rows = t.message.select("id", "session_id").join(t.session.select(F.col("id").alias("session_id"), "started_at", "last_activity"), "session_id")
    return sequences.interpolated(rows, ["session_id"], "id", "started_at", "last_activity").select("id", "at_us")


@query("win_16", """SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY a, b, seq) AS place FROM (
      SELECT id, session_id, seq, seq AS a, 0 AS b FROM message WHERE role <> 'tool' UNION ALL SELECT id, session_id, seq, 1, 1 FROM message WHERE role = 'tool'))""")  # fmt: skip
def win_16(t: Lake) -> DataFrame:
    rows = t.message.select("id", "session_id", "seq", "role")
    return sequences.spliced(rows.where("role <> 'tool'"), rows.where("role = 'tool'").withColumn("anchor", F.lit(1)), "session_id", "seq", "anchor").select("id", "place")


FOREST = """link AS (SELECT id AS child, id // 10 AS parent FROM session WHERE id >= 10), m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, id, message_time, content_text) AS p FROM message),
    calls AS (SELECT session_id AS parent, p AS spot, row_number() OVER (PARTITION BY session_id ORDER BY p) AS rank FROM m WHERE role = 'tool'), kids AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS rank FROM link),
    known AS MATERIALIZED (SELECT k.child, k.parent, [coalesce(c.spot, 2147483647), 1, k.rank] AS step FROM kids k LEFT JOIN calls c USING (parent, rank)),
    tree AS (SELECT id // 10 AS node, id // 10 AS root, CAST([] AS BIGINT[][]) AS path FROM session WHERE id BETWEEN 10 AND 99 GROUP BY 1 UNION ALL SELECT k.child, t.root, list_append(t.path, k.step) FROM tree t JOIN known k ON k.parent = t.node)"""


@query("win_16_forest", f"WITH RECURSIVE {FOREST} SELECT m.id, m.session_id, coalesce(t.root, m.session_id) AS root, row_number() OVER (PARTITION BY coalesce(t.root, m.session_id) ORDER BY list_append(coalesce(t.path, []), [m.p, 0, 0]), m.session_id) AS place FROM m LEFT JOIN tree t ON t.node = m.session_id")
def win_16_forest(t: Lake) -> DataFrame:
    """Messages of sub-agents, and of theirs, behind the tool rows that called them; each tree is numbered anew."""
    links = t.session.where("id >= 10").select(F.col("id").alias("child"), F.expr("id div 10").alias("parent"), F.col("id").alias("rank"))
    messages = t.message.select("id", "session_id", "seq", "message_time", "content_text", "role")
    found = sequences.spliced_forest(messages, links, ["seq", "id", "message_time", "content_text"], F.col("role") == "tool")
    return found.select("id", "session_id", "root", "place")


@query("jn_25_totals", """WITH RECURSIVE up AS (SELECT id, id AS root FROM session UNION ALL SELECT id, root // 10 FROM up WHERE root >= 10), top AS (SELECT id, min(root) AS root FROM up GROUP BY 1)
    SELECT root, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(started_at) AS started_at, max(last_activity) AS last_activity, count(*) AS sessions FROM session JOIN top USING (id) GROUP BY 1""")  # fmt: skip
def jn_25_totals(t: Lake) -> DataFrame:
    """Tokens and times of whole trees of sub-agents."""
    links = t.session.where("id >= 10").select(F.col("id").alias("child"), F.expr("id div 10").alias("parent"))
    return sequences.tree_totals(t.session, links, ["input_tokens", "output_tokens"], "started_at", "last_activity")


@query("win_17", "SELECT id, tokens_delta * input_tokens_delta // nullif(input_tokens_delta + output_tokens_delta, 0) AS input_part FROM event")
def win_17(t: Lake) -> DataFrame:
    return t.event.select("id", F.expr("case when input_tokens_delta + output_tokens_delta <> 0 then tokens_delta * input_tokens_delta div (input_tokens_delta + output_tokens_delta) end").alias("input_part"))


# ---- JSON hits and capabilities

HITS = """hit AS (SELECT id, user_code, session_id, CAST(message_time AS DATE) AS work_date, trim(h->>'token') AS token, lower(trim(h->>'kind')) AS kind FROM (
      SELECT *, unnest(CAST(slash_hits_json AS JSON[])) AS h FROM message WHERE contains(slash_hits_json, '{')) WHERE trim(h->>'token') <> '')"""
ITEM = "nullif(lower(regexp_replace(regexp_replace(token, '^[/$]+', ''), '^skills/', '')), '')"
MCP = "regexp_extract(lower(trim(tool_name)), '^mcp__([^_\\s]\\S*?|_[^_\\s]\\S*?)__(\\S+)$', {})"
TOLD = f"""part AS (SELECT CAST(message_time AS DATE) AS work_date, user_code, session_id, p->>'tool_name' AS tool_name FROM (SELECT *, unnest(CAST(content_parts_json AS JSON[])) AS p FROM message WHERE json_valid(content_parts_json)) WHERE p->>'type' = 'tool_call'),
    told AS (SELECT * FROM part x WHERE {MCP.format(1)} <> '' AND NOT EXISTS (SELECT 1 FROM event e WHERE e.session_id = x.session_id AND CAST(e.event_time AS DATE) = x.work_date AND {MCP.format(1).replace("tool_name", "e.tool_name")} <> ''))"""
CAPABILITY = f"""{HITS}, {TOLD}, used AS (SELECT work_date, user_code, session_id, kind, {ITEM} AS item FROM hit WHERE kind IN ('skill', 'nl_skill')),
    parts AS (SELECT work_date, user_code, session_id, 'plugin' AS kind, split_part(item, ':', 1) AS item, split_part(item, ':', 2) AS sub FROM used WHERE contains(item, ':')
      UNION ALL SELECT CAST(event_time AS DATE), user_code, session_id, 'mcp', {MCP.format(1)}, {MCP.format(2)} FROM event WHERE starts_with(lower(tool_name), 'mcp__') AND {MCP.format(1)} <> ''
      UNION ALL SELECT work_date, user_code, session_id, 'mcp', {MCP.format(1)}, {MCP.format(2)} FROM told),
    capability AS (SELECT work_date, user_code, kind, item, sub_item, count(*) AS invoke_count, count(DISTINCT session_id) AS session_count FROM (
      SELECT work_date, user_code, session_id, kind, item, '' AS sub_item FROM used WHERE item IS NOT NULL UNION ALL SELECT work_date, user_code, session_id, kind, item, '' FROM parts UNION ALL SELECT work_date, user_code, session_id, kind, item, sub FROM parts) GROUP BY ALL)"""


@query("agg_m10", f"WITH {HITS} SELECT token, count(*) AS uses, count(DISTINCT user_code) AS users, count(DISTINCT session_id) AS sessions FROM hit WHERE kind <> 'noise' GROUP BY 1")
def agg_m10(t: Lake) -> DataFrame:
    return hits.ranking(t.message)


@query("agg_m10_user", f"WITH {HITS} SELECT user_code, token, count(*) AS uses, count(DISTINCT user_code) AS users, count(DISTINCT session_id) AS sessions FROM hit WHERE kind <> 'noise' GROUP BY 1, 2")
def agg_m10_user(t: Lake) -> DataFrame:
    return hits.ranking(t.message, ["user_code"])


@query("agg_m11", f"WITH {HITS}, f AS (SELECT session_id, token, kind, min(id) AS i FROM hit GROUP BY ALL) SELECT session_id, string_agg(token || '|' || kind, ',' ORDER BY i, token, kind) AS tokens FROM f GROUP BY 1")
def agg_m11(t: Lake) -> DataFrame:
    return hits.first_seen(t.message)


def capabilities(t: Lake) -> DataFrame:
    """MAT-2, built once."""
    return built(t, "capability_daily", ("lineitem",), lambda: hits.capability_daily(t.message, t.event), "work_date")


@query("agg_c7", f"WITH {CAPABILITY} SELECT * FROM capability")
def agg_c7(t: Lake) -> DataFrame:
    return capabilities(t)


@query("agg_c8", f"WITH {TOLD} SELECT work_date, user_code, session_id, {MCP.format(1)} AS server, {MCP.format(2)} AS tool, count(*) AS calls FROM told GROUP BY ALL")
def agg_c8(t: Lake) -> DataFrame:
    """Content parts count only for session days without an MCP event."""
    names = [text.mcp_server(F.col("tool_name")).alias("server"), text.mcp_tool(F.col("tool_name")).alias("tool")]
    return hits.part_calls(t.message, t.event).groupBy("work_date", "user_code", "session_id", *names).agg(F.count(F.lit(1)).alias("calls"))


CAPABILITY_ROLLUPS = {
    "agg_c1": (["item", "kind"], "sub_item = ''", {"invoke_count": "sum(invoke_count)", "users": "count(distinct user_code)", "session_count": "sum(session_count)"}),
    "agg_c2": (["item"], "sub_item = ''", {"users": "count(distinct user_code)"}),
    "agg_c3": (["item", "sub_item"], "sub_item <> ''", {"invoke_count": "sum(invoke_count)", "session_count": "sum(session_count)"}),
    "agg_c4": (["work_date", "kind"], "sub_item = ''", {"invoke_count": "sum(invoke_count)"}),
    "agg_c5": (["user_code", "item"], "sub_item = ''", {"invoke_count": "sum(invoke_count)"}),
    "agg_c6": (["kind", "item", "sub_item"], "user_code = 'u7'", {"invoke_count": "sum(invoke_count)", "session_count": "sum(session_count)"}),
}


def capability_rollup(keys: list[str], where: str, measures: dict[str, str]):
    return lambda t: capabilities(t).where(where).groupBy(*keys).agg(*[F.expr(f"cast({e} as bigint)").alias(k) for k, e in measures.items()])


for name, (keys, where, measures) in CAPABILITY_ROLLUPS.items():
    columns = ", ".join([*keys, *[f"CAST({e} AS BIGINT) AS {k}" for k, e in measures.items()]])
    query(name, f"WITH {CAPABILITY} SELECT {columns} FROM capability WHERE {where} GROUP BY {', '.join(keys)}")(capability_rollup(keys, where, measures))


# ---- daily summary

TOKENS = """tok AS (SELECT user_code, CAST(last_activity AS DATE) AS day, CAST(least(sum(CASE WHEN input_tokens BETWEEN 0 AND 2000000000 THEN input_tokens ELSE 0 END), 5000000000) AS BIGINT) AS input_tokens FROM session WHERE invalid_reason IS NULL GROUP BY 1, 2)"""
DAILY = f"""{GAPS}, {ACTIVE}, {UNION}, {THINKING}, {RESPONSE}, {RETRIES},
    resp AS (SELECT user_code, day, CAST(sum(first_response_ms) AS BIGINT) // count(*) AS first_response_ms FROM response WHERE first_response_ms > 0 AND first_response_ms < 1800000 GROUP BY ALL),
    ret AS (SELECT user_code, day, CAST(sum(retries) AS BIGINT) AS retries FROM retry GROUP BY ALL),
    base AS (SELECT user_code, CAST(signal_time AS DATE) AS day, count(DISTINCT session_id) AS sessions, count(*) FILTER (status = 'tool') AS tool_calls, count(*) FILTER (lower(trim(role)) = 'user') AS user_messages, count(*) FILTER (lower(trim(role)) = 'assistant') AS assistant_messages, CAST(sum(CASE WHEN tokens BETWEEN 0 AND 2000000000 THEN tokens ELSE 0 END) AS BIGINT) AS tokens FROM activity GROUP BY 1, 2),
    own_model AS (SELECT user_code, CAST(signal_time AS DATE) AS day, model, sum(CASE WHEN tokens BETWEEN 0 AND 2000000000 THEN tokens ELSE 0 END) AS t FROM activity GROUP BY 1, 2, 3),
    top AS (SELECT user_code, day, string_agg(model, ',' ORDER BY t DESC, model) AS top_models FROM (SELECT *, row_number() OVER (PARTITION BY user_code, day ORDER BY t DESC, model) AS n FROM own_model WHERE t > 0 AND model IS NOT NULL) WHERE n <= 3 GROUP BY 1, 2),
    daily AS (SELECT user_code, day AS work_date, sessions, tool_calls, user_messages, assistant_messages, top_models, least(tokens, 5000000000) AS tokens, coalesce(active_seconds, 0) AS active_seconds, coalesce(union_seconds, 0) AS union_seconds, coalesce(thinking_seconds, 0) AS thinking_seconds,
      coalesce(first_response_ms, 0) AS first_response_ms, coalesce(retries, 0) AS retries FROM base LEFT JOIN active USING (user_code, day) LEFT JOIN united USING (user_code, day) LEFT JOIN thinking USING (user_code, day) LEFT JOIN resp USING (user_code, day) LEFT JOIN ret USING (user_code, day) LEFT JOIN top USING (user_code, day))"""


def daily_summary(signals: DataFrame) -> DataFrame:
    """MAT-1: one row per user and day.

    Signals are dealt out by user and day once for each metric, which serves all its windows and groups, none of which
    leaves its day; the metrics are then rows of one union, which meet in one aggregation instead of a chain of joins.
    """
    by = ["user_code", "day"]
    days = signals.withColumn("day", F.to_date("signal_time")).repartition(*by)
    own = days.drop("day")
    sane = F.expr("case when tokens between 0 and 2000000000 then tokens else 0 end")
    says = lambda who: F.count_if(filters.role() == who)
    models = days.where("model is not null").groupBy(*by, "model").agg(F.sum(sane).alias("t")).where("t > 0")
    best = sequences.top_values(models, by, "model", "t")  # the first three
    top = best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda m: m["model"]), ",").alias("top_models"))
    base = days.groupBy(by).agg(F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("status") == "tool").alias("tool_calls"), says("user").alias("user_messages"), says("assistant").alias("assistant_messages"), F.least(F.sum(sane), F.lit(5_000_000_000)).alias("tokens"))
    answered = sequences.first_response(own, BY).where("first_response_ms > 0 and first_response_ms < 1800000")
    parts = [
        base,
        sequences.interval_seconds(sequences.activity_intervals(own, BY), ["user_code"]),
        sequences.state_seconds(own, BY, "thinking").groupBy(by).agg(F.sum("thinking_seconds").alias("thinking_seconds")),
        answered.groupBy(by).agg(F.expr("sum(first_response_ms) div count(*)").alias("first_response_ms")),
        sequences.retries(own, BY).groupBy(by).agg(F.sum("retries").alias("retries")),
    ]
    names = [c for part in parts for c in part.columns if c not in by]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, top])
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    return rows.groupBy(by).agg(*sums, F.max("top_models").alias("top_models")).withColumnRenamed("day", "work_date")


def summary(t: Lake) -> DataFrame:
    """MAT-1, built once."""
    return built(t, "daily_summary", ("events",), lambda: daily_summary(t.activity), "work_date")


@query("mat_1", f"WITH {DAILY} SELECT * FROM daily")
def mat_1(t: Lake) -> DataFrame:
    return summary(t)


SUMMARY_ROLLUPS = {
    "agg_d2": (["user_code"], {"union_seconds": "sum(union_seconds)"}),
    "agg_d3": (["user_code"], {"retries": "sum(retries)", "tool_calls": "sum(tool_calls)"}),
    "agg_d5": (["work_date"], {"tokens": "sum(tokens)"}),
}


def summary_rollup(keys: list[str], measures: dict[str, str]):
    return lambda t: summary(t).where("work_date between date '2024-01-01' and date '2024-01-30'").groupBy(*keys).agg(*[F.expr(f"cast({e.format(div='div')} as bigint)").alias(k) for k, e in measures.items()])


for name, (keys, measures) in SUMMARY_ROLLUPS.items():
    columns = ", ".join([*keys, *[f"CAST({e.format(div='//')} AS BIGINT) AS {k}" for k, e in measures.items()]])
    query(name, f"WITH {DAILY} SELECT {columns} FROM daily WHERE work_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY {', '.join(keys)}")(summary_rollup(keys, measures))


WINDOW = ("2024-01-01", "2024-01-30", "2024-01-20")  # first and last day of a window, and the day on which it is looked at


@query("agg_d6", f"""WITH {DAILY}, w AS (SELECT *, split_part(top_models, ',', 1) AS top FROM daily WHERE work_date BETWEEN DATE '{WINDOW[0]}' AND least(DATE '{WINDOW[1]}', DATE '{WINDOW[2]}')),
    m AS (SELECT user_code, top, sum(tokens) AS t FROM w WHERE top <> '' GROUP BY 1, 2), best AS (SELECT user_code, top AS top_model FROM m QUALIFY row_number() OVER (PARTITION BY user_code ORDER BY t DESC, top) = 1),
    s AS (SELECT user_code, count(*) AS days_with_data, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(active_seconds) AS BIGINT) // (date_diff('day', DATE '{WINDOW[0]}', least(DATE '{WINDOW[1]}', DATE '{WINDOW[2]}')) + 1) AS active_per_day,
      CAST(sum(first_response_ms) AS BIGINT) // nullif(count(*) FILTER (first_response_ms > 0), 0) AS first_response_ms FROM w GROUP BY 1)
    SELECT s.*, top_model FROM s LEFT JOIN best USING (user_code)""")  # fmt: skip
def agg_d6(t: Lake) -> DataFrame:
    """People over a window as far as it has passed: means over its days, answers over days with any, and the model that led the days with most tokens."""
    first, last = F.lit(WINDOW[0]).cast("date"), F.least(F.lit(WINDOW[1]).cast("date"), F.lit(WINDOW[2]).cast("date"))
    rows = summary(t).where(F.col("work_date").between(first, last)).withColumn("top", F.get(F.split("top_models", ","), F.lit(0)))
    models = rows.where("top is not null").groupBy("user_code", "top").agg(F.sum("tokens").alias("t"))
    best = models.groupBy("user_code").agg(F.min(F.struct((-F.col("t")).alias("t"), "top"))["top"].alias("top_model"))
    answered = F.nullif(F.count_if(F.col("first_response_ms") > 0), F.lit(0))
    days = F.date_diff(last, first) + 1
    found = rows.groupBy("user_code").agg(F.count(F.lit(1)).alias("days_with_data"), F.sum("sessions").alias("sessions"), F.floor(F.sum("active_seconds") / days).alias("active_per_day"), F.floor(F.sum("first_response_ms") / answered).alias("first_response_ms"))
    return found.join(best, "user_code", "left")


@query("agg_d1", """SELECT count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'ACTIVE' AND last_seen > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 300 SECOND) AS online,
    greatest(0, count(*) FILTER (status = 'ACTIVE') - count(*) FILTER (status = 'ACTIVE' AND last_seen > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 300 SECOND)) AS offline FROM device""")  # fmt: skip
def agg_d1(t: Lake) -> DataFrame:
    found = t.device.agg(F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(filters.online("2024-01-31 12:00:00")).alias("online"))
    return found.withColumn("offline", F.greatest(F.lit(0), F.col("active") - F.col("online")))


@query("agg_d7", """WITH w AS (SELECT user_code, CAST(sum(tokens) FILTER (signal_time >= TIMESTAMP '2024-01-15' AND signal_time < TIMESTAMP '2024-01-22') AS BIGINT) AS now_tokens, CAST(sum(tokens) FILTER (signal_time >= TIMESTAMP '2024-01-08' AND signal_time < TIMESTAMP '2024-01-15') AS BIGINT) AS before_tokens FROM activity GROUP BY 1)
    SELECT user_code, coalesce(now_tokens, 0) AS now_tokens, coalesce(before_tokens, 0) AS before_tokens, CASE WHEN coalesce(before_tokens, 0) <> 0 THEN CAST(floor((coalesce(now_tokens, 0) - before_tokens) * 100.0 / before_tokens + 0.5) AS BIGINT) END AS change_pct FROM w""")  # fmt: skip
def agg_d7(t: Lake) -> DataFrame:
    """This ISO week against the one before, in one scan."""
    week = F.date_trunc("week", F.col("signal_time").cast("timestamp")).cast("date")
    total = {n: F.coalesce(F.sum(F.when(week == F.lit(d).cast("date"), F.col("tokens"))), F.lit(0)).alias(n) for n, d in (("now_tokens", "2024-01-15"), ("before_tokens", "2024-01-08"))}
    found = t.activity.groupBy("user_code").agg(*total.values())
    return found.withColumn("change_pct", F.when(F.col("before_tokens") != 0, text.java_round((F.col("now_tokens") - F.col("before_tokens")) * 100.0 / F.col("before_tokens")).cast("long")))


@query("agg_p1", """WITH base AS (SELECT s.project_name, s.model, e.user_code, CAST(sum(e.tokens_delta) AS BIGINT) AS tokens, count(DISTINCT e.session_id) AS sessions, max(e.event_time) AS last_time, max(s.repo_url) AS repo_url
      FROM event e JOIN session s ON e.session_id = s.id WHERE s.invalid_reason IS NULL AND s.project_name IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT project_name, model, sum(tokens) AS t FROM base WHERE model IS NOT NULL GROUP BY 1, 2),
      top AS (SELECT project_name, model FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY t DESC, model) AS n FROM m) WHERE n = 1)
    SELECT b.project_name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sessions) AS BIGINT) AS sessions, count(DISTINCT user_code) AS users, max(last_time) AS last_time, max(repo_url) AS repo_url, any_value(top.model) AS top_model FROM base b LEFT JOIN top USING (project_name) GROUP BY 1""")  # fmt: skip
def agg_p1(t: Lake) -> DataFrame:
    """The project fold of AGG-E9; the session count is the sum of the groups' counts."""
    sessions = filters.valid(t.session).where("project_name is not null").select(F.col("id").alias("session_id"), "project_name", "model", "repo_url")
    base = t.event.join(sessions, "session_id").groupBy("project_name", "model", "user_code").agg(F.sum("tokens_delta").alias("tokens"), F.count_distinct("session_id").alias("sessions"), F.max("event_time").alias("last_time"), F.max("repo_url").alias("repo_url"))
    models = base.where("model is not null").groupBy("project_name", "model").agg(F.sum("tokens").alias("t"))
    top = models.groupBy("project_name").agg(F.min(F.struct((-F.col("t")).alias("t"), F.col("model").alias("m")))["m"].alias("top_model"))
    users = base.groupBy("project_name", "user_code").agg(F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"), F.max("last_time").alias("last_time"), F.max("repo_url").alias("repo_url"))
    whole = users.groupBy("project_name").agg(F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"), F.count(F.lit(1)).alias("users"), F.max("last_time").alias("last_time"), F.max("repo_url").alias("repo_url"))
    return whole.join(top, "project_name", "left")


QUERIES, ORACLES = query.queries, query.oracles
