"""MAT-4 and what reads it; commit attribution, its roll-ups and the penetration built on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import attribution, filters, hits, joins, report, shapes, stats

from .aggregates import END, START
from .behaviour import CAPABILITY, capabilities
from .bindings import Lake
from .materialised import built
from .registry import Registry
from .relational import AUDITED, NORM, audited, half_open
from .relational import NOW as TODAY

query = Registry()
TOOLS = {"urgent": "claude", "high": "cursor", "medium": "codex"}

# ---- the report, written from its rules for DuckDB


def r4(e: str) -> str:
    return f"floor(({e}) * 10000 + 0.5) / 10000"


def clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


REVERT = """regexp_matches({}.message_subject, '(?i)^\\s*revert(\\s|:|")')"""
REPORT = f"""own AS (SELECT * FROM session WHERE invalid_reason IS NULL AND ({half_open('started_at')} OR {half_open('last_activity')})),
    us AS (SELECT user_code, count(*) AS sessions, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM own GROUP BY 1),
    rated AS (SELECT own.user_code, a.*, [1, 2, 4, 8, 16][a.difficulty] * CASE WHEN a.disagreement THEN 3 ELSE 10 END AS w, CASE a.outcome WHEN 'completed' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS twice FROM own JOIN audit a ON a.session_id = own.id),
    ua AS (SELECT user_code, count(*) AS audited, floor(avg(difficulty) * 100 + 0.5) / 100 AS avg_difficulty, count(*) FILTER (difficulty <= 2) AS easy, {r4('count(*) FILTER (difficulty >= 4) * 1.0 / count(*)')} AS high_difficulty_ratio,
      {r4("count(*) FILTER (difficulty >= 4 AND outcome = 'completed') * 1.0 / count(*)")} AS high_completed_ratio, {r4('sum(w * twice) / (2.0 * sum(w))')} AS completion_rate, {r4("count(*) FILTER (outcome = 'abandoned') * 1.0 / count(*)")} AS abandoned_rate,
      {", ".join(f"floor(sum(w * {c}) * 1.0 / sum(w) * 100 + 0.5) / 100 AS {c}" for c in report.CAPABILITIES)}, {", ".join(r4(f"count(*) FILTER (mode = '{m}') * 1.0 / count(*)") + f" AS {m}" for m in report.MODES)} FROM rated GROUP BY 1),
    made AS (SELECT * FROM commits WHERE {half_open('commit_time')}),
    hard AS (SELECT own.* FROM own JOIN audit a ON a.session_id = own.id WHERE a.difficulty >= 4),
    undone AS (SELECT DISTINCT c.id FROM made c JOIN commits r ON r.user_code = c.user_code AND r.repo_url IS NOT DISTINCT FROM c.repo_url AND r.commit_hash <> c.commit_hash WHERE {REVERT.format('r')} AND r.commit_time > c.commit_time AND r.commit_time <= c.commit_time + INTERVAL 7 DAY AND r.commit_time < TIMESTAMP '{END}' + INTERVAL 7 DAY),
    near AS (SELECT DISTINCT c.id FROM made c JOIN hard h ON h.user_code = c.user_code WHERE h.started_at <= c.commit_time + INTERVAL 5 MINUTE AND h.last_activity >= c.commit_time - INTERVAL 30 MINUTE AND (h.repo_url IS NULL OR c.repo_url IS NULL OR h.repo_url = c.repo_url)),
    uc AS (SELECT user_code, count(*) AS commits, CAST(sum(lines_added) AS BIGINT) AS lines, {r4('count(*) FILTER (c.id IN (SELECT id FROM undone)) * 1.0 / count(*)')} AS revert_rate, {r4('count(*) FILTER (c.id IN (SELECT id FROM near)) * 1.0 / count(*)')} AS high_commit_ratio FROM made c GROUP BY 1),
    act AS (SELECT user_code, sum(active_seconds) AS active_seconds FROM work GROUP BY 1),
    base AS (SELECT us.*, coalesce(active_seconds, 0) / 3600.0 AS active_hours, coalesce(audited, 0) AS audited, coalesce(audited, 0) < 10 AS insufficient, coalesce(easy, 0) AS easy, ua.* EXCLUDE (user_code, audited, easy), coalesce(commits, 0) AS commits, coalesce(lines, 0) AS lines, revert_rate, high_commit_ratio
      FROM us LEFT JOIN act USING (user_code) LEFT JOIN ua ON ua.user_code = us.user_code LEFT JOIN uc ON uc.user_code = us.user_code),
    metrics AS (SELECT *, CASE WHEN commits > 0 AND active_hours > 0 THEN {r4('commits / active_hours')} END AS commits_per_hour, CASE WHEN commits > 0 AND tokens > 0 THEN {r4('lines * 1000.0 / tokens')} END AS lines_per_1k FROM base),
    enough AS (SELECT *, coalesce(commits_per_hour, 0) AS pace FROM metrics WHERE NOT insufficient),
    raws AS (SELECT e.*, 100 * (0.35 * {clamp(f"({' + '.join(report.CAPABILITIES)}) / 5 / 5")} + 0.25 * coalesce((SELECT count(*) FILTER (x.commits_per_hour <= e.pace) * 1.0 / nullif(count(x.commits_per_hour), 0) FROM enough x), 0)
      + 0.20 * (0.6 * {clamp('completion_rate')} + 0.4 * CASE WHEN commits >= 3 AND revert_rate IS NOT NULL THEN {clamp('1 - revert_rate')} ELSE 0.5 END) + 0.15 * {clamp('high_completed_ratio')} + 0.05 * {clamp('(leverage - dependent + 1) / 2')}) AS raw FROM enough e),
    team AS (SELECT avg(raw) AS mean, quantile_cont(active_hours, 0.75) AS hours_75, quantile_cont(commits_per_hour, 0.25) AS pace_25, quantile_cont(commits_per_hour, 0.5) AS pace_50, quantile_cont(CAST(sessions AS DOUBLE), 0.1) AS sessions_10 FROM raws),
    finals AS (SELECT user_code, raw, audited / (audited + 10.0) * raw + (1 - audited / (audited + 10.0)) * mean AS final, concat_ws(',', CASE WHEN sessions >= 15 AND active_hours >= hours_75 AND pace <= pace_25 THEN 'high_invest_low_output' END, CASE WHEN commits >= 5 AND coalesce(revert_rate, 0) > 0.25 THEN 'high_revert' END,
      CASE WHEN sessions >= 15 AND easy * 1.0 / sessions > 0.80 THEN 'low_difficulty' END, CASE WHEN sessions >= 15 AND dependent > 0.35 THEN 'high_dependent' END, CASE WHEN sessions >= 15 AND debugging > 0.40 AND pace <= pace_25 THEN 'debugging_loop' END, CASE WHEN sessions <= sessions_10 AND commits >= 3 AND pace >= pace_50 THEN 'silent_productive' END) AS flags FROM raws, team),
    report AS (SELECT m.*, raw, final, CASE WHEN final >= 85 THEN 'S' WHEN final >= 70 THEN 'A' WHEN final >= 55 THEN 'B' WHEN final >= 40 THEN 'C' WHEN final IS NOT NULL THEN 'D' END AS grade, CASE WHEN final IS NOT NULL THEN CASE WHEN m.audited >= 20 THEN 'normal' ELSE 'low' END END AS confidence,
      CASE WHEN final IS NOT NULL THEN (SELECT count(*) FILTER (y.final <= f.final) * 100.0 / count(*) FROM finals y) END AS percentile, flags FROM metrics m LEFT JOIN finals f ON f.user_code = m.user_code)"""


def analysis(t: Lake) -> DataFrame:
    """MAT-4, built once for the window."""

    def build() -> DataFrame:
        active = t.work.groupBy("user_code").agg(F.sum("active_seconds").alias("active_seconds"))
        return report.scored(report.user_metrics(t.session, t.audit, t.commits, active, START, END))

    return built(t, f"report {START[:10]} {END[:10]}".replace(" ", "_"), ("orders", "events"), build)


ROUNDED = ("raw", "final", "percentile", "active_hours")
REPORT_COLUMNS = ["user_code", "sessions", "tokens", "active_hours", "audited", "insufficient", "avg_difficulty", "high_difficulty_ratio", "completion_rate", "abandoned_rate", *report.CAPABILITIES, *report.MODES, "commits", "lines", "commits_per_hour", "lines_per_1k", "revert_rate", "high_commit_ratio", "raw", "final", "grade", "confidence", "percentile", "flags"]


@query("mat_4", f"WITH {REPORT} SELECT {', '.join(f'round({c}, 6) AS {c}' if c in ROUNDED else c for c in REPORT_COLUMNS)} FROM report")
def mat_4(t: Lake) -> DataFrame:
    """The whole report; audit figures of insufficient users are in it, scores are not."""
    return analysis(t).select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in REPORT_COLUMNS])


@query("st_4", f"WITH {REPORT} SELECT user_code, round(raw, 6) AS score FROM report WHERE raw IS NOT NULL")
def st_4(t: Lake) -> DataFrame:
    return analysis(t).where("raw is not null").select("user_code", F.round("raw", 6).alias("score"))


@query("st_5", f"WITH {REPORT} SELECT user_code, round(final, 6) AS final_score, grade, confidence FROM report WHERE final IS NOT NULL")
def st_5(t: Lake) -> DataFrame:
    return analysis(t).where("final is not null").select("user_code", F.round("final", 6).alias("final_score"), "grade", "confidence")


@query("st_6", f"WITH {REPORT} SELECT user_code, flags FROM report WHERE final IS NOT NULL")
def st_6(t: Lake) -> DataFrame:
    return analysis(t).where("final is not null").select("user_code", "flags")


@query("st_8", f"WITH {REPORT} SELECT user_code, commits_per_hour, lines_per_1k, revert_rate, high_commit_ratio FROM report")
def st_8(t: Lake) -> DataFrame:
    return analysis(t).select("user_code", "commits_per_hour", "lines_per_1k", "revert_rate", "high_commit_ratio")


@query("jn_20", f"WITH {REPORT} SELECT e.user_code, grade, confidence FROM employee e LEFT JOIN report r ON r.user_code = e.user_code")
def jn_20(t: Lake) -> DataFrame:
    return t.employee.select("user_code").join(analysis(t).select("user_code", "grade", "confidence"), "user_code", "left")


@query("prj_9", f"WITH {REPORT} SELECT user_code, grade, confidence, DATE '{START[:10]}' AS window_from, DATE '{END[:10]}' - 1 AS window_to FROM report")
def prj_9(t: Lake) -> DataFrame:
    """Grade badges with the report's window."""
    return analysis(t).select("user_code", "grade", "confidence", F.lit(START[:10]).cast("date").alias("window_from"), F.date_sub(F.lit(END[:10]).cast("date"), 1).alias("window_to"))


# ---- attribution; the rules as they are due, in their order

RULES = [
    ("claude_code", "claude", "generated with \\[?claude code\\]?"),
    ("claude_code", "claude", "claude-session:\\s*\\S+"),
    ("claude_coauthor", "claude", "co-authored-by:\\s*claude"),
    ("codex", "codex", "co-authored-by:\\s*(openai[- ])?codex"),
    ("codex", "codex", "generated with (openai )?codex"),
    ("cursor", "cursor", "co-authored-by:\\s*cursor"),
    ("cursor", "cursor", "generated with cursor"),
    ("copilot", "copilot", "co-authored-by:\\s*(github[- ])?copilot"),
    ("aider", "aider", "co-authored-by:\\s*aider"),
    ("gemini", "gemini", "co-authored-by:\\s*gemini"),
]
CASES = {n: "CASE " + " ".join(f"WHEN regexp_matches(coalesce(message_body, ''), '(?i){p}') THEN '{(kind, tool)[n]}'" for kind, tool, p in RULES) + " END" for n in (0, 1)}
ATTRIBUTION = f"""c AS (SELECT *, {NORM.format('repo_url')} AS repo, {CASES[0]} AS trailer_kind, {CASES[1]} AS rule_tool FROM commits WHERE is_merge = 0),
    s AS (SELECT *, {NORM.format('repo_url')} AS s_repo, CASE target_type WHEN 'urgent' THEN 'claude' WHEN 'high' THEN 'cursor' WHEN 'medium' THEN 'codex' ELSE target_type END AS s_tool FROM session WHERE invalid_reason IS NULL),
    p AS (SELECT c.id, s.id AS session_id, s.model, s.project_name, s.s_tool, s.started_at, s.last_activity, c.commit_time, coalesce(c.repo = s.s_repo, false) AS same FROM c JOIN s ON c.user_code = s.user_code
          AND s.started_at <= c.commit_time + INTERVAL 30 MINUTE AND s.last_activity >= c.commit_time - INTERVAL 30 MINUTE WHERE CASE WHEN c.trailer_kind IS NOT NULL THEN s.s_tool = c.rule_tool ELSE coalesce(c.repo = s.s_repo, false) END),
    g AS (SELECT p.id, p.session_id, p.model, p.project_name, p.s_tool, p.same, p.started_at, p.last_activity, p.commit_time, max(e.event_time) AS sig FROM p LEFT JOIN event e ON e.session_id = p.session_id AND e.event_time <= p.commit_time AND e.event_time >= p.commit_time - INTERVAL 30 MINUTE GROUP BY ALL),
    r AS (SELECT *, greatest(0, (least(epoch_us(last_activity), epoch_us(commit_time + INTERVAL 30 MINUTE)) - greatest(epoch_us(started_at), epoch_us(commit_time - INTERVAL 30 MINUTE))) // 1000000) AS overlap_seconds,
          coalesce(sig, CASE WHEN started_at <= commit_time THEN least(last_activity, commit_time) END) AS signal FROM g),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same DESC, signal DESC NULLS LAST, overlap_seconds DESC, session_id) AS n FROM r),
    attribution AS (SELECT c.id, c.user_code, c.commit_time, c.lines_added, c.lines_deleted, CASE WHEN c.trailer_kind IS NOT NULL THEN 'B' WHEN b.session_id IS NOT NULL THEN 'A' ELSE 'NONE' END AS tier, c.trailer_kind, coalesce(c.rule_tool, b.s_tool) AS tool, b.session_id, b.project_name,
           CASE WHEN b.session_id IS NOT NULL THEN b.model WHEN c.trailer_kind IS NOT NULL THEN 'unknown' END AS model, coalesce(b.overlap_seconds, 0) AS overlap_seconds FROM c LEFT JOIN b ON b.id = c.id AND b.n = 1)"""


def attributed(t: Lake) -> DataFrame:
    """MAT-3, built once."""
    return built(t, "attribution", ("orders", "lineitem"), lambda: attribution.attribute(t.commits, t.session, t.event, TOOLS), "commit_time")


@query("win_9", f"WITH {ATTRIBUTION} SELECT id, tier, trailer_kind, tool, session_id, project_name, model, overlap_seconds FROM attribution")
def win_9(t: Lake) -> DataFrame:
    return attributed(t).select("id", "tier", "trailer_kind", "tool", "session_id", "project_name", "model", "overlap_seconds")


@query("win_10", f"WITH {ATTRIBUTION} SELECT p.id, p.session_id, count(e.id) AS signals, max(e.event_time) AS last_signal FROM p LEFT JOIN event e ON e.session_id = p.session_id AND e.event_time <= p.commit_time AND e.event_time >= p.commit_time - INTERVAL 30 MINUTE GROUP BY 1, 2")
def win_10(t: Lake) -> DataFrame:
    """The signals that count for a commit and a session: those of the window before this commit, whatever else is in a batch."""
    return attribution.signals(t.commits, t.session, t.event, TOOLS)


@query("jn_11", f"WITH {ATTRIBUTION} SELECT b.id, b.session_id, b.signal, b.overlap_seconds FROM b WHERE n = 1")
def jn_11(t: Lake) -> DataFrame:
    """The as-of join of commits with the session whose last signal before them is the latest."""
    return attribution.nearest(attribution.placed(t.commits, t.session, t.event, TOOLS)).select("id", "session_id", "signal", "overlap_seconds")


@query("jn_5", f"WITH {ATTRIBUTION} SELECT a.id, a.tier, a.session_id, c.commit_hash, c.message_subject FROM attribution a, commits c WHERE a.id = c.id AND c.user_code = 'u9' ORDER BY 1")
def jn_5(t: Lake) -> DataFrame:
    """Attributed commits of a user with their own columns."""
    commits = t.commits.where(filters.optional("user_code", "u9"))
    found = attribution.attribute(commits, t.session, t.event, TOOLS).select("id", "tier", "session_id")
    return found.join(commits.select("id", "commit_hash", "message_subject"), "id").orderBy("id")


ROLLUPS = {
    "agg_g1": ([], {"ai_lines": "coalesce(sum(case when tier <> 'NONE' then lines_added end), 0)", "all_lines": "coalesce(sum(lines_added), 0)"}),
    "agg_g3": (["day", "tier"], {"n": "count(*)", "lines_added": "sum(lines_added)"}),
    "agg_g4": (["user_code", "project_name", "tool", "model", "tier"], {"n": "count(*)", "lines_added": "sum(lines_added)", "lines_deleted": "sum(lines_deleted)"}),
}


def rollup(keys: list[str], measures: dict[str, str]):
    return lambda t: attributed(t).withColumn("day", F.to_date("commit_time")).groupBy(*keys).agg(*[F.expr(f"cast({e} as bigint)").alias(k) for k, e in measures.items()])


for name, (keys, measures) in ROLLUPS.items():
    columns = ", ".join([*keys, *[f"CAST({e} AS BIGINT) AS {k}" for k, e in measures.items()]])
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    query(name, f"WITH {ATTRIBUTION} SELECT {columns} FROM (SELECT *, CAST(commit_time AS DATE) AS day FROM attribution){group}")(rollup(keys, measures))


@query("fn_g4", f"WITH {ATTRIBUTION} SELECT coalesce(project_name, '') AS project_name, coalesce(model, '') AS model, tier, count(*) AS n, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted FROM attribution WHERE tool = 'claude' GROUP BY 1, 2, 3")
def fn_g4(t: Lake) -> DataFrame:
    """A pivot on chosen dimensions, always with the tier; any of four filters may be given."""
    return shapes.pivot_by(attributed(t), ["project_name"], ["model"], {"n": "count(*)", "lines_added": "sum(lines_added)", "lines_deleted": "sum(lines_deleted)"}, always=["tier"], only={"tool": "claude", "user_code": None, "project_name": None, "model": None})


@query("fn_g5", f"""WITH {ATTRIBUTION}, d AS (SELECT CAST(commit_time AS DATE) AS day, coalesce(sum(lines_added - lines_deleted) FILTER (tier = 'B'), 0) AS b_lines, coalesce(sum(lines_added - lines_deleted) FILTER (tier = 'A'), 0) AS a_lines, coalesce(sum(lines_added - lines_deleted) FILTER (tier = 'NONE'), 0) AS none_lines FROM attribution GROUP BY 1)
    SELECT day, CAST(b_lines AS BIGINT) AS b_lines, CAST(a_lines AS BIGINT) AS a_lines, CAST(none_lines AS BIGINT) AS none_lines, CASE WHEN b_lines + a_lines + none_lines <> 0 THEN {r4('(b_lines + a_lines) * 1.0 / (b_lines + a_lines + none_lines)')} END AS ai_share FROM d""")  # fmt: skip
def fn_g5(t: Lake) -> DataFrame:
    """Net lines by tier, one column each, and the share of both AI tiers."""
    net = F.col("lines_added") - F.col("lines_deleted")
    tiers = [F.coalesce(F.sum(F.when(F.col("tier") == tier, net)), F.lit(0)).alias(f"{tier.lower()}_lines") for tier in ("B", "A", "NONE")]
    days = attributed(t).groupBy(F.to_date("commit_time").alias("day")).agg(*tiers)
    return days.withColumn("ai_share", stats.ratio((F.col("b_lines") + F.col("a_lines")) * 1.0, F.col("b_lines") + F.col("a_lines") + F.col("none_lines")))


LEGACY = f"""legacy AS (SELECT c.*, EXISTS (SELECT 1 FROM session s WHERE s.user_code = c.user_code AND s.invalid_reason IS NULL AND {NORM.format('s.repo_url')} = {NORM.format('c.repo_url')}
    AND c.commit_time BETWEEN s.started_at - INTERVAL 30 MINUTE AND s.last_activity + INTERVAL 30 MINUTE) AS ai FROM commits c WHERE is_merge = 0 AND repo_url IS NOT NULL)"""


def legacy(t: Lake, since: str | None = None) -> DataFrame:
    """Commits that are no merges, with ai: whether a session of the repository was near (JN-6)."""
    commits = t.commits.where("is_merge = 0 and repo_url is not null").select("id", "user_code", "commit_time", "lines_added", text.norm_repo(F.col("repo_url")).alias("repo"))
    if since:
        commits = commits.where(F.col("commit_time") >= F.lit(since).cast("timestamp_ntz"))
    sessions = filters.valid(t.session).select(F.col("user_code").alias("_user"), text.norm_repo(F.col("repo_url")).alias("_repo"), "started_at", "last_activity")
    near = joins.band(commits, sessions, {"user_code": "_user", "repo": "_repo"}, "commit_time", F.col("started_at") - joins.minutes(30), F.col("last_activity") + joins.minutes(30), "left_semi")
    return commits.join(near.select("id", F.lit(True).alias("ai")), "id", "left").withColumn("ai", F.coalesce("ai", F.lit(False)))


@query("agg_g2", f"WITH {LEGACY} SELECT CAST(coalesce(sum(lines_added) FILTER (ai), 0) AS BIGINT) AS ai_lines, CAST(coalesce(sum(lines_added), 0) AS BIGINT) AS all_lines FROM legacy WHERE commit_time >= TIMESTAMP '{START}'")
def agg_g2(t: Lake) -> DataFrame:
    """Penetration by the older rule."""
    zero = F.lit(0)
    return legacy(t, START).agg(F.coalesce(F.sum(F.when(F.col("ai"), F.col("lines_added"))), zero).alias("ai_lines"), F.coalesce(F.sum("lines_added"), zero).alias("all_lines"))


NOW = "1997-06-01"


@query("st_14", f"""WITH {ATTRIBUTION}, {LEGACY}, w AS (SELECT unnest([1, 7, 30]) AS days),
    x AS (SELECT days, coalesce(sum(lines_added) FILTER (tier <> 'NONE'), 0) AS ai, coalesce(sum(lines_added), 0) AS whole FROM w LEFT JOIN attribution ON commit_time >= TIMESTAMP '{NOW}' - to_days(CAST(days AS INTEGER)) AND commit_time < TIMESTAMP '{NOW}' GROUP BY 1),
    y AS (SELECT days, coalesce(sum(lines_added) FILTER (legacy.ai), 0) AS ai, coalesce(sum(lines_added), 0) AS whole FROM w LEFT JOIN legacy ON commit_time >= TIMESTAMP '{NOW}' - to_days(CAST(days AS INTEGER)) AND commit_time < TIMESTAMP '{NOW}' GROUP BY 1),
    z AS (SELECT days, CASE WHEN x.whole > 0 THEN CAST(floor(x.ai * 100.0 / x.whole + 0.5) AS BIGINT) ELSE -1 END AS attribution_pct, CASE WHEN y.whole > 0 THEN CAST(floor(y.ai * 100.0 / y.whole + 0.5) AS BIGINT) ELSE -1 END AS legacy_pct FROM x JOIN y USING (days))
    SELECT days, CASE WHEN attribution_pct >= 0 THEN attribution_pct ELSE legacy_pct END AS penetration, legacy_pct, attribution_pct, CASE WHEN attribution_pct < 0 OR legacy_pct < 0 THEN -1 ELSE abs(legacy_pct - attribution_pct) END AS deviation FROM z""")  # fmt: skip
def st_14(t: Lake) -> DataFrame:
    """Penetration over 1, 7 and 30 days before a moment: by attribution, else by the older rule; and how far both are apart."""
    now = F.lit(NOW).cast("timestamp_ntz")

    def percents(rows: DataFrame, ai: Column, name: str) -> DataFrame:
        found = []
        for days in (1, 7, 30):
            inside = (F.col("commit_time") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("commit_time") < now)
            part, whole = (F.coalesce(F.sum(F.when(test, F.col("lines_added"))), F.lit(0)) for test in (inside & ai, inside))
            found.append(F.struct(F.lit(days).alias("days"), stats.percent(part, whole).alias(name)))
        return rows.agg(F.array(*found).alias("w")).select(F.inline("w"))

    new, old = percents(attributed(t), F.col("tier") != "NONE", "attribution_pct"), percents(legacy(t), F.col("ai"), "legacy_pct")
    both = new.join(F.broadcast(old), "days")  # three rows
    known = F.when(F.col("attribution_pct") >= 0, F.col("attribution_pct")).otherwise(F.col("legacy_pct"))
    apart = F.when((F.col("attribution_pct") < 0) | (F.col("legacy_pct") < 0), F.lit(-1)).otherwise(F.abs(F.col("legacy_pct") - F.col("attribution_pct")))
    return both.select("days", known.alias("penetration"), "legacy_pct", "attribution_pct", apart.cast("long").alias("deviation"))


@query("fn_g10", f"WITH w AS (SELECT unnest([1, 7, 30]) AS days) SELECT days, CASE WHEN days = 1 THEN date_trunc('day', TIMESTAMP '{END}' + INTERVAL 12 HOUR) ELSE TIMESTAMP '{END}' + INTERVAL 12 HOUR - to_days(CAST(days AS INTEGER)) END AS since, count(c.id) AS commits FROM w LEFT JOIN commits c ON c.commit_time >= CASE WHEN days = 1 THEN date_trunc('day', TIMESTAMP '{END}' + INTERVAL 12 HOUR) ELSE TIMESTAMP '{END}' + INTERVAL 12 HOUR - to_days(CAST(days AS INTEGER)) END GROUP BY 1, 2")
def fn_g10(t: Lake) -> DataFrame:
    """Commits since the beginnings of the penetration windows: today, and rolling 7 and 30 times 24 hours."""
    now = F.lit(END).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    begins = {1: F.date_trunc("day", now).cast("timestamp_ntz")} | {d: now - F.make_dt_interval(days=F.lit(d)) for d in (7, 30)}
    rows = [F.struct(F.lit(d).alias("days"), since.alias("since"), F.count_if(F.col("commit_time") >= since).alias("commits")) for d, since in begins.items()]
    return t.commits.agg(F.array(*rows).alias("w")).select(F.inline("w"))


# ---- audits and capabilities


@query("agg_s9", f"WITH {AUDITED} SELECT count(*) FILTER (due) AS pending, count(*) FILTER (stable) AS stable, count(*) AS valid, greatest(0, count(*) - count(*) FILTER (stable)) AS unaudited FROM audited")
def agg_s9(t: Lake) -> DataFrame:
    """Valid sessions with messages that are due for an audit (FLT-16), audited and still as they were, and all."""
    found = audited(t).agg(F.count_if(filters.needs_audit(TODAY)).alias("pending"), F.count_if(filters.stably_audited()).alias("stable"), F.count_if(F.col("total_messages") > 0).alias("valid"))
    return found.withColumn("unaudited", F.greatest(F.lit(0), F.col("valid") - F.col("stable")))


def ranking_sql(kinds: str) -> str:
    return f"""WITH {CAPABILITY}, own AS (SELECT * FROM capability WHERE kind IN ({kinds})),
    whole AS (SELECT item, CAST(sum(invoke_count) AS BIGINT) AS uses, count(DISTINCT user_code) AS users, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(CASE WHEN kind = 'nl_skill' THEN invoke_count ELSE 0 END) AS BIGINT) AS natural FROM own WHERE sub_item = '' GROUP BY 1),
    child AS (SELECT item, sub_item, sum(invoke_count) AS uses, sum(session_count) AS sessions FROM own WHERE sub_item <> '' GROUP BY 1, 2), listed AS (SELECT item, string_agg(sub_item || '|' || uses || '|' || sessions, ',' ORDER BY uses DESC, sub_item) AS children FROM child GROUP BY 1)
    SELECT whole.item, uses, users, sessions, uses - "natural" AS explicit, "natural", coalesce(children, '') AS children FROM whole LEFT JOIN listed ON listed.item = whole.item ORDER BY uses DESC, whole.item LIMIT 20"""


@query("fn_g8", ranking_sql("'skill', 'nl_skill'"))
def fn_g8(t: Lake) -> DataFrame:
    """The ranking of skills, explicit and natural-language uses merged."""
    return hits.capability_ranking(capabilities(t), ["skill", "nl_skill"])


@query("fn_g8_mcp", ranking_sql("'mcp'"))
def fn_g8_mcp(t: Lake) -> DataFrame:
    """The ranking of servers with their tools."""
    return hits.capability_ranking(capabilities(t), ["mcp"])


QUERIES, ORACLES = query.queries, query.oracles
