"""The analysis report (MAT-4): metrics of each user in a window, scores, grades and watch-list flags.

A user has fewer than ``ENOUGH`` audited sessions: insufficient, with base figures only, and out of all baselines.
Team-wide figures (percentiles, mean) are one row, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text

from . import filters, stats
from .joins import band, minutes

ENOUGH, WATCHED = 10, 15
CAPABILITIES = ("cap_problem", "cap_context", "cap_debug", "cap_tool", "cap_self")
MODES = ("leverage", "dependent", "debugging")
#: Ten times the weight of difficulty 1..5, as whole numbers, and what of ten a disagreement leaves.
WEIGHTS, DISAGREED = (1, 2, 4, 8, 16), 3


def share(part: Column, whole: Column) -> Column:
    return text.java_round(part * 1.0 / whole, 4)


def audit_metrics(sessions: DataFrame, audits: DataFrame) -> DataFrame:
    """ST-7, ST-9 per user: audited sessions, weighted means, shares of modes and difficulties."""
    rows = sessions.select("user_code", F.col("id").alias("session_id")).join(audits, "session_id")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("difficulty")) * F.when(F.col("disagreement"), DISAGREED).otherwise(10)
    twice = F.when(F.col("outcome") == "completed", 2).when(F.col("outcome") == "partial", 1).otherwise(0)
    rows = rows.withColumn("w", weight)
    n, w, hard = F.count(F.lit(1)), F.sum("w"), F.col("difficulty") >= 4
    return rows.groupBy("user_code").agg(
        n.alias("audited"),
        text.java_round(F.avg("difficulty"), 2).alias("avg_difficulty"),
        F.count_if(F.col("difficulty") <= 2).alias("easy"),
        share(F.count_if(hard), n).alias("high_difficulty_ratio"),
        share(F.count_if(hard & (F.col("outcome") == "completed")), n).alias("high_completed_ratio"),
        text.java_round(F.sum(F.col("w") * twice) / (2.0 * w), 4).alias("completion_rate"),
        share(F.count_if(F.col("outcome") == "abandoned"), n).alias("abandoned_rate"),
        *[text.java_round(F.sum(F.col("w") * F.col(c)) * 1.0 / w, 2).alias(c) for c in CAPABILITIES],
        *[share(F.count_if(F.col("mode") == m), n).alias(m) for m in MODES],
    )


def commit_metrics(sessions: DataFrame, audits: DataFrame, commits: DataFrame, start: str, end: str) -> DataFrame:
    """ST-8 per user: commits, lines, the share reverted within a week (JN-13) and made beside hard sessions (JN-12)."""
    inside = commits.where(filters.between("commit_time", start, end)).select("id", "user_code", "commit_time", "commit_hash", "lines_added", "repo_url")
    week = F.make_dt_interval(days=F.lit(7))
    late = F.lit(end).cast("timestamp_ntz") + week
    reverts = commits.where(text.is_revert(F.col("message_subject")) & (F.col("commit_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("commit_time") < late))
    reverts = reverts.select(F.col("user_code").alias("_user"), F.coalesce("repo_url", F.lit("\0")).alias("_repo"), F.col("commit_hash").alias("_hash"), F.col("commit_time").alias("_time"))
    bases = inside.select("id", F.col("user_code").alias("_own"), F.coalesce("repo_url", F.lit("\0")).alias("_at"), "commit_hash", "commit_time")
    reverted = band(reverts, bases, {"_user": "_own", "_repo": "_at"}, "_time", F.col("commit_time"), F.col("commit_time") + week, seconds=7 * 86_400)
    reverted = reverted.where("_time > commit_time and _hash <> commit_hash").select("id").distinct()
    hard = sessions.join(audits.where("difficulty >= 4").select(F.col("session_id").alias("id")), "id", "left_semi")
    hard = hard.select(F.col("user_code").alias("_user"), F.col("repo_url").alias("_repo"), "started_at", "last_activity")
    beside = band(inside, hard, {"user_code": "_user"}, "commit_time", F.col("started_at") - minutes(5), F.col("last_activity") + minutes(30))
    beside = beside.where(F.col("_repo").isNull() | F.col("repo_url").isNull() | (F.col("_repo") == F.col("repo_url"))).select("id").distinct()
    marked = inside.join(reverted.withColumn("reverted", F.lit(1)), "id", "left").join(beside.withColumn("beside", F.lit(1)), "id", "left")
    n = F.count(F.lit(1))
    return marked.groupBy("user_code").agg(n.alias("commits"), F.sum("lines_added").alias("lines"), share(F.count("reverted"), n).alias("revert_rate"), share(F.count("beside"), n).alias("high_commit_ratio"))


def user_metrics(sessions: DataFrame, audits: DataFrame, commits: DataFrame, active: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each user with a session in the window. ``active``: user_code, active_seconds."""
    own = filters.valid(sessions).where(filters.touches(start, end))
    base = own.groupBy("user_code").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.expr("input_tokens + output_tokens")).alias("tokens"))
    hours = (F.coalesce("active_seconds", F.lit(0)) / 3600.0).alias("active_hours")
    rows = base.join(active, "user_code", "left").select("user_code", "sessions", "tokens", hours)
    rows = rows.join(audit_metrics(own, audits), "user_code", "left").join(commit_metrics(own, audits, commits, start, end), "user_code", "left")
    rows = rows.fillna(0, ["audited", "easy", "commits", "lines"])
    some = F.col("commits") > 0
    return rows.withColumns({
        "insufficient": F.col("audited") < ENOUGH,
        "commits_per_hour": F.when(some & (F.col("active_hours") > 0), share(F.col("commits"), F.col("active_hours"))),
        "lines_per_1k": F.when(some & (F.col("tokens") > 0), text.java_round(F.col("lines") * 1000.0 / F.col("tokens"), 4)),
    })


def scored(metrics: DataFrame) -> DataFrame:
    """``metrics`` with raw and final score, grade, confidence, percentile and watch-list flags; null for insufficient users."""
    enough = metrics.where("not insufficient")
    zero = F.lit(0.0)
    pace = F.coalesce("commits_per_hour", zero)
    ranks = stats.value_ranks(enough, "commits_per_hour", "pace_pct")
    capability = sum((F.col(c) for c in CAPABILITIES), zero) / len(CAPABILITIES)
    # a user without the figure counts as 0, which no value that makes the ranks is below
    rows = enough.join(ranks, "commits_per_hour", "left").withColumn("capability", capability)
    raw = stats.raw_score(F.col("capability"), F.coalesce("pace_pct", zero) / 100, F.col("completion_rate"), F.col("revert_rate"), F.col("commits"), F.col("high_completed_ratio"), F.col("leverage"), F.col("dependent"))
    rows = rows.withColumn("raw", raw)
    point = {f"{c}_{p}": F.percentile(c, F.lit(p / 100)).alias(f"{c}_{p}") for c, p in (("active_hours", 75), ("commits_per_hour", 25), ("commits_per_hour", 50), ("sessions", 10))}
    team = rows.agg(F.avg("raw").alias("mean"), *point.values())
    rows = rows.crossJoin(F.broadcast(team))  # one row
    rows = rows.withColumn("final", stats.shrunk(F.col("raw"), F.col("mean"), F.col("audited")))
    many = F.col("sessions") >= WATCHED
    slow = pace <= F.col("commits_per_hour_25")
    rules = {
        "high_invest_low_output": many & (F.col("active_hours") >= F.col("active_hours_75")) & slow,
        "high_revert": (F.col("commits") >= 5) & (F.coalesce("revert_rate", zero) > 0.25),
        "low_difficulty": many & (F.col("easy") / F.col("sessions") > 0.80),
        "high_dependent": many & (F.col("dependent") > 0.35),
        "debugging_loop": many & (F.col("debugging") > 0.40) & slow,
        "silent_productive": (F.col("sessions") <= F.col("sessions_10")) & (F.col("commits") >= 3) & (pace >= F.col("commits_per_hour_50")),
    }
    rows = rows.select("user_code", "capability", "raw", "final", stats.grade(F.col("final")).alias("grade"), stats.confidence(F.col("audited")).alias("confidence"), stats.flags(rules).alias("flags"))
    return metrics.join(stats.rank_percentile(rows, "final", "percentile"), "user_code", "left")
