"""FN-G and ST: shapes and statistics, and the analysis report (MAT-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.functions import text
from pulsegrid.operators import report, shapes, stats

from .bindings import Lake
from .registry import Registry

query = Registry()
FROM, TO = "2024-01-05", "2024-02-03"
DAYS = f"days AS (SELECT CAST(unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY)) AS DATE) AS day)"
BY_DAY = "d AS (SELECT CAST(signal_time AS DATE) AS day, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM activity GROUP BY 1, 2)"


def by_day(t: Lake) -> DataFrame:
    return t.activity.groupBy(F.to_date("signal_time").alias("day"), "model").agg(F.sum("tokens").alias("tokens"))


@query("fn_g1", f"WITH {BY_DAY}, {DAYS} SELECT day, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM days LEFT JOIN d USING (day) GROUP BY 1")
def fn_g1(t: Lake) -> DataFrame:
    daily = t.activity.groupBy(F.to_date("signal_time").alias("day")).agg(F.sum("tokens").alias("tokens"))
    return shapes.gap_filled(daily, "day", ["tokens"], FROM, TO)


@query("fn_g2", f"""WITH {BY_DAY}, {DAYS}, top AS (SELECT model, row_number() OVER (ORDER BY sum(tokens) DESC, model) - 1 AS place FROM d GROUP BY 1 ORDER BY 2 LIMIT 3)
    SELECT model, place, day, day - DATE '{FROM}' AS day_index, coalesce(tokens, 0) AS tokens FROM top CROSS JOIN days LEFT JOIN d USING (model, day)""")  # fmt: skip
def fn_g2(t: Lake) -> DataFrame:
    return shapes.top_grid(by_day(t), "day", "model", "tokens", FROM, TO, 3)


@query("fn_g3", """WITH c AS (SELECT user_code, tool_name, count(*) AS n FROM event WHERE tool_name IS NOT NULL GROUP BY 1, 2), u AS (SELECT user_code, row_number() OVER (ORDER BY sum(n) DESC, user_code) - 1 AS row_index FROM c GROUP BY 1 ORDER BY 2 LIMIT 20),
    i AS (SELECT tool_name, row_number() OVER (ORDER BY sum(n) DESC, tool_name) - 1 AS column_index FROM c GROUP BY 1 ORDER BY 2 LIMIT 20) SELECT row_index, column_index, n FROM c JOIN u USING (user_code) JOIN i USING (tool_name)""")  # fmt: skip
def fn_g3(t: Lake) -> DataFrame:
    calls = t.event.where("tool_name is not null").groupBy("user_code", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    return shapes.matrix(calls, "user_code", "tool_name", "n").select("row_index", "column_index", "n")


@query("fn_g7", "WITH m AS (SELECT model, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM session WHERE model IS NOT NULL GROUP BY 1) SELECT model, tokens, floor(tokens * 1000.0 / (SELECT CASE WHEN sum(tokens) = 0 THEN 1 ELSE sum(tokens) END FROM m) + 0.5) / 10 AS share_pct FROM m")
def fn_g7(t: Lake) -> DataFrame:
    return shapes.share_of_total(t.session.where("model is not null").groupBy("model").agg(F.sum("input_tokens").alias("tokens")), "tokens")


@query("srt_8", """WITH c AS (SELECT content_text AS item, CASE WHEN contains(content_text, 'skill') THEN 'skill' ELSE 'command' END AS kind, count(*) AS n FROM message GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS place FROM c)
    SELECT CASE WHEN place <= 22 THEN item ELSE 'other:' || kind END AS item, kind, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")  # fmt: skip
def srt_8(t: Lake) -> DataFrame:
    kind = F.when(F.col("content_text").contains("skill"), "skill").otherwise("command")
    counts = t.message.groupBy(F.col("content_text").alias("item"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.with_other(counts, "item", "kind", "n")


@query("srt_9", """WITH s AS (SELECT a.*, CASE WHEN outcome = 'completed' THEN row_number() OVER (PARTITION BY outcome ORDER BY difficulty DESC, session_id) END AS hard_done, row_number() OVER (ORDER BY capability DESC, session_id) AS able,
      CASE WHEN outcome = 'abandoned' THEN row_number() OVER (PARTITION BY outcome ORDER BY difficulty DESC, session_id) END AS hard_left, row_number() OVER (ORDER BY difficulty DESC, session_id) AS hard FROM audit a),
    p AS (SELECT session_id, CASE WHEN hard_done <= 2 THEN hard_done WHEN able <= 2 THEN 10 + able WHEN hard_left <= 2 THEN 20 + hard_left ELSE 30 + hard END AS priority FROM s) SELECT session_id, row_number() OVER (ORDER BY priority, session_id) AS place FROM p ORDER BY 2 LIMIT 6""")  # fmt: skip
def srt_9(t: Lake) -> DataFrame:
    """Highlights: two hardest completed, two most able, two hardest abandoned, then by difficulty; no session twice."""
    pool = t.audit
    best = [("hard_done", pool.where("outcome = 'completed'"), "difficulty", 0), ("able", pool, "capability", 10), ("hard_left", pool.where("outcome = 'abandoned'"), "difficulty", 20), ("hard", pool, "difficulty", 30)]
    parts = None
    for _, df, by, offset in best:
        top = df.orderBy(F.desc(by), "session_id").limit(2 if offset < 30 else 12)
        part = top.select("session_id", (F.row_number().over(W.orderBy(F.desc(by), "session_id")) + offset).alias("priority"))
        parts = part if parts is None else parts.unionByName(part)
    chosen = parts.groupBy("session_id").agg(F.min("priority").alias("priority")).orderBy("priority", "session_id").limit(6)
    return chosen.select("session_id", F.row_number().over(W.orderBy("priority", "session_id")).cast("long").alias("place"))


# ---- statistics


@query("st_2", "SELECT project_name, " + ", ".join(f"floor(quantile_cont(CAST(input_tokens AS DOUBLE), {p / 100}) * 1000 + 0.5) / 1000 AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM session GROUP BY 1")
def st_2(t: Lake) -> DataFrame:
    return stats.percentiles(t.session.withColumn("x", F.col("input_tokens").cast("double")), ["project_name"], "x")


@query("st_3", "WITH u AS (SELECT user_code, count(*) AS n FROM session GROUP BY 1) SELECT user_code, n, cume_dist() OVER (ORDER BY n) * 100 AS rank_pct FROM u")
def st_3(t: Lake) -> DataFrame:
    return stats.rank_percentile(t.session.groupBy("user_code").agg(F.count(F.lit(1)).alias("n")), "n")


USER_AUDITS = """ua AS (SELECT s.user_code, count(*) AS audited, sum(w * CASE outcome WHEN 'completed' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) / (2.0 * sum(w)) AS weighted
      FROM session s JOIN (SELECT *, [1, 2, 4, 8, 16][difficulty] * CASE WHEN disagreement THEN 3 ELSE 10 END AS w FROM audit) a ON a.session_id = s.id GROUP BY 1)"""


@query("st_7", f"WITH {USER_AUDITS} SELECT user_code, audited, CASE WHEN audited >= 10 THEN floor(weighted * 10000 + 0.5) / 10000 END AS weighted FROM ua")
def st_7(t: Lake) -> DataFrame:
    found = report.audit_metrics(t.session, t.audit)
    return found.select("user_code", "audited", F.when(F.col("audited") >= 10, F.col("completion_rate")).alias("weighted"))


@query("st_9", "SELECT d AS difficulty, coalesce(n, 0) AS n FROM (SELECT unnest([1, 2, 3, 4, 5]) AS d) LEFT JOIN (SELECT difficulty, count(*) AS n FROM audit GROUP BY 1) ON d = difficulty")
def st_9(t: Lake) -> DataFrame:
    keys = t.spark.range(1, 6).select(F.col("id").cast("int").alias("difficulty"))
    return keys.join(t.audit.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n")), "difficulty", "left").fillna(0, ["n"])


@query("st_9_mode", "WITH m AS (SELECT mode, count(*) AS n FROM audit GROUP BY 1) SELECT mode, floor(n * 10000.0 / (SELECT sum(n) FROM m) + 0.5) / 10000 AS share FROM m")
def st_9_mode(t: Lake) -> DataFrame:
    counts = t.audit.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("mode", stats.ratio(F.col("n"), F.col("total")).alias("share"))


@query("st_10", """SELECT session_id, CAST(floor((difficulty + second_difficulty) / 2.0 + 0.5) AS INTEGER) AS difficulty, abs(difficulty - second_difficulty) > 1 OR outcome <> second_outcome AS disagreement,
    CASE WHEN second_difficulty > difficulty THEN second_outcome ELSE outcome END AS outcome FROM audit""")  # fmt: skip
def st_10(t: Lake) -> DataFrame:
    level, apart = stats.consensus(F.col("difficulty"), F.col("second_difficulty"))
    chosen = F.when(F.col("second_difficulty") > F.col("difficulty"), F.col("second_outcome")).otherwise(F.col("outcome"))
    return t.audit.select("session_id", level.alias("difficulty"), (apart | (F.col("outcome") != F.col("second_outcome"))).alias("disagreement"), chosen.alias("outcome"))


@query("st_11", "SELECT floor(avg(CASE WHEN disagreement THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS disagreement_ratio FROM audit")
def st_11(t: Lake) -> DataFrame:
    return t.audit.agg(text.java_round(F.avg(F.when(F.col("disagreement"), 1.0).otherwise(0.0)), 4).alias("disagreement_ratio"))


@query("st_12", """WITH x AS (SELECT user_code, CASE WHEN id % 97 = 0 THEN -5 WHEN id % 89 = 0 THEN 6000000000 ELSE input_tokens END AS v FROM session)
    SELECT user_code, CAST(CASE WHEN sum(v) BETWEEN 0 AND 5000000000 THEN sum(v) ELSE least(sum(CASE WHEN v BETWEEN 0 AND 2000000000 THEN v ELSE 0 END), 5000000000) END AS BIGINT) AS tokens FROM x GROUP BY 1""")  # fmt: skip
def st_12(t: Lake) -> DataFrame:
    value = F.when(F.col("id") % 97 == 0, F.lit(-5)).when(F.col("id") % 89 == 0, F.lit(6_000_000_000)).otherwise(F.col("input_tokens"))
    return t.session.select("user_code", value.alias("v")).groupBy("user_code").agg(stats.guarded_sum("v").alias("tokens"))


@query("st_13", "WITH x AS (SELECT id, user_code, CASE WHEN id % 13 = 0 THEN -1 ELSE tokens END AS v, lag(tokens) OVER (PARTITION BY user_code ORDER BY id) AS p FROM activity) SELECT id, CASE WHEN v BETWEEN 0 AND 2000000000 THEN v ELSE coalesce(p, 0) END AS accepted FROM x")
def st_13(t: Lake) -> DataFrame:
    rows = t.activity.withColumn("p", F.lag("tokens").over(W.partitionBy("user_code").orderBy("id"))).withColumn("v", F.when(F.col("id") % 13 == 0, F.lit(-1)).otherwise(F.col("tokens")))
    return rows.select("id", stats.accepted_total(F.col("v"), F.col("p")).alias("accepted"))


@query("st_15", """WITH e AS (SELECT session_id, CAST(sum(tokens_delta) AS BIGINT) AS d FROM event GROUP BY 1)
    SELECT s.id, CASE WHEN d IS NULL THEN 'no_events' WHEN input_tokens > 100 * d THEN 'inflated' WHEN d > input_tokens THEN 'events_exceed' ELSE 'plausible' END AS verdict, floor(CAST(input_tokens AS DOUBLE) / nullif(output_tokens, 0) * 100 + 0.5) / 100 AS in_out FROM session s LEFT JOIN e ON e.session_id = s.id""")  # fmt: skip
def st_15(t: Lake) -> DataFrame:
    sums = t.event.groupBy(F.col("session_id").alias("id")).agg(F.sum("tokens_delta").alias("d"))
    verdict = F.when(F.col("d").isNull(), "no_events").when(F.col("input_tokens") > 100 * F.col("d"), "inflated").when(F.col("d") > F.col("input_tokens"), "events_exceed").otherwise("plausible")
    return t.session.select("id", "input_tokens", "output_tokens").join(sums, "id", "left").select("id", verdict.alias("verdict"), stats.ratio(F.col("input_tokens"), F.col("output_tokens"), 2).alias("in_out"))


@query("st_16", """WITH e AS (SELECT session_id, CAST(sum(CASE WHEN tokens_delta BETWEEN 0 AND 500000000 THEN tokens_delta ELSE 0 END) AS BIGINT) AS d FROM event WHERE event_type = 'TOOL_CALL' GROUP BY 1), m AS (SELECT session_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS n FROM message WHERE role = 'tool' GROUP BY 1)
    SELECT s.id, CASE WHEN input_tokens < 100000 THEN input_tokens WHEN coalesce(d, 0) > 0 THEN d WHEN coalesce(n, 0) > 0 THEN n ELSE 0 END AS repaired FROM session s LEFT JOIN e ON e.session_id = s.id LEFT JOIN m ON m.session_id = s.id""")  # fmt: skip
def st_16(t: Lake) -> DataFrame:
    """A total that is out of bounds is replaced by its tool deltas' sum, else its tool messages', else 0."""
    sane = F.when(F.col("tokens_delta").between(0, 500_000_000), F.col("tokens_delta")).otherwise(0)
    deltas = t.event.where("event_type = 'TOOL_CALL'").groupBy(F.col("session_id").alias("id")).agg(F.sum(sane).alias("d"))
    said = t.message.where("role = 'tool'").groupBy(F.col("session_id").alias("id")).agg(F.sum(F.expr("input_tokens + output_tokens")).alias("n"))
    rows = t.session.select("id", "input_tokens").join(deltas, "id", "left").join(said, "id", "left")
    return rows.select("id", F.when(F.col("input_tokens") < 100_000, F.col("input_tokens")).when(F.col("d") > 0, F.col("d")).when(F.col("n") > 0, F.col("n")).otherwise(0).alias("repaired"))


@query("st_17", "SELECT user_code, CASE WHEN sum(user_messages) <> 0 THEN floor(sum(assistant_messages) * 100.0 / sum(user_messages) + 0.5) / 100 END AS qa_ratio FROM session GROUP BY 1")
def st_17(t: Lake) -> DataFrame:
    return t.session.groupBy("user_code").agg(stats.ratio(F.sum("assistant_messages"), F.sum("user_messages"), 2).alias("qa_ratio"))


# ---- scalar functions over whole columns

@query("fn_scalars", """SELECT id, nullif(regexp_extract(tool_name, '^mcp__([^_\\s]\\S*?)__(\\S+)$', 1), '') AS raw_server, split_part(commit_ref, ':', 1) AS head, floor(ratio * 100 + 0.5) / 100 AS rounded
    FROM (SELECT id, tool_name, 'c' || session_id || ':x' AS commit_ref, tokens_delta / (1.0 + messages_delta) AS ratio FROM event)""")  # fmt: skip
def fn_scalars(t: Lake) -> DataFrame:
    server = F.regexp_extract("tool_name", r"^mcp__([^_\s]\S*?)__(\S+)$", 1)
    ref = F.concat(F.lit("c"), "session_id", F.lit(":x"))
    return t.event.select("id", F.when(server != "", server).alias("raw_server"), F.substring_index(ref, ":", 1).alias("head"), text.java_round(F.col("tokens_delta") / (1.0 + F.col("messages_delta")), 2).alias("rounded"))


QUERIES, ORACLES = query.queries, query.oracles
