"""The rules on names and texts, and the commonest reads, as functions of Spark SQL.

``register(spark)`` makes the scalar ones, which stay inside the JVM; ``register_tables(spark, folder)`` shows the
logical tables as views and adds functions that return tables: ``SELECT * FROM person_commits('u7', DATE '1996-01-01', DATE '1996-12-31')``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pulsegrid.plans.bindings import TABLES, Lake

_TOKEN = r"regexp_replace(regexp_replace(trim(token), r'^[/$]+', ''), r'^skills/', '')"
_MCP = r"nullif(regexp_extract(lower(trim(tool)), r'^mcp__(?!__)(\S+?)__(\S+)$', {}), '')"

SCALARS = {
    "norm_repo(url STRING) RETURNS STRING": r"nullif(lower(regexp_replace(regexp_replace(trim(url), r'(?i)(\.git)+$', ''), r'/+$', '')), '')",
    "first_token(body STRING) RETURNS STRING": r"nullif(regexp_extract(body, r'^\s*(\S+)', 1), '')",
    "mcp_server(tool STRING) RETURNS STRING": _MCP.format(1),
    "mcp_tool(tool STRING) RETURNS STRING": _MCP.format(2),
    "skill_item(token STRING) RETURNS STRING": f"nullif(lower({_TOKEN}), '')",
    "skill_namespace(item STRING) RETURNS STRING": r"nullif(regexp_extract(item, r'^([^\s:]+):[^\s:]+$', 1), '')",
    "is_revert(subject STRING) RETURNS BOOLEAN": r"""coalesce(subject, '') RLIKE r'(?i)^\s*revert(\s|:|")'""",
    "short_model(name STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), r'^.*/', ''), r'[-@]\d{8}$', ''), r'-(latest|preview|exp)$', '')",
    "half_up(x DOUBLE, digits INT) RETURNS DOUBLE": "floor(x * power(10, digits) + 0.5) / power(10, digits)",
    "unit_range(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, x))",
    "saturating_add(a BIGINT, b BIGINT) RETURNS BIGINT": "coalesce(try_add(a, b), CASE WHEN a < 0 AND b IS NOT NULL THEN -9223372036854775807 - 1 WHEN a IS NOT NULL AND b IS NOT NULL THEN 9223372036854775807 END)",
}

_INSIDE = "{} >= cast(first AS timestamp_ntz) AND {} < cast(date_add(last, 1) AS timestamp_ntz)"
_WINDOW = "first DATE, last DATE"
_COMMIT = "id BIGINT, user_code STRING, commit_hash STRING, project_name STRING, commit_time TIMESTAMP_NTZ, lines_added BIGINT, lines_deleted BIGINT, message_subject STRING"


def _commits(test: str) -> str:
    names = ", ".join(c.split()[0] for c in _COMMIT.split(", "))
    return f"SELECT {names} FROM commits WHERE {test} AND {_INSIDE.format('commit_time', 'commit_time')}"


READS = {
    f"person_commits(who STRING, {_WINDOW}) RETURNS TABLE ({_COMMIT})": _commits("user_code = who"),
    f"project_commits(which STRING, {_WINDOW}) RETURNS TABLE ({_COMMIT})": _commits("project_name = which"),
    f"project_totals({_WINDOW}) RETURNS TABLE (project_name STRING, tokens BIGINT, sessions BIGINT, users BIGINT)": f"""
        SELECT s.project_name, sum(e.tokens_delta), count(DISTINCT e.session_id), count(DISTINCT e.user_code) FROM event e JOIN session s ON s.id = e.session_id
        WHERE s.invalid_reason IS NULL AND s.project_name IS NOT NULL AND {_INSIDE.format('e.event_time', 'e.event_time')} GROUP BY s.project_name""",
    f"tool_calls(who STRING, {_WINDOW}) RETURNS TABLE (tool_name STRING, calls BIGINT, sessions BIGINT)": f"""
        SELECT tool_name, count(*), count(DISTINCT session_id) FROM event WHERE event_type = 'TOOL_CALL' AND tool_name IS NOT NULL AND (who IS NULL OR user_code = who) AND {_INSIDE.format('event_time', 'event_time')} GROUP BY tool_name""",
    "session_events(which BIGINT) RETURNS TABLE (id BIGINT, event_time TIMESTAMP_NTZ, event_type STRING, status STRING, tool_name STRING, tokens_delta BIGINT)": "SELECT id, event_time, event_type, status, tool_name, tokens_delta FROM event WHERE session_id = which",
}


def register(spark: SparkSession) -> None:
    """The scalar functions, for this session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_tables(spark: SparkSession, folder: str) -> None:
    """Views of the logical tables below ``folder``, and the functions that read them."""
    lake = Lake(spark, folder)
    for name in TABLES:
        getattr(lake, name).createOrReplaceTempView(name)
    for head, body in READS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
