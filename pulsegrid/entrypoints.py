"""What a console asks for, by path: with parameters (``call``), or the named queries over whole tables that answer it (``read``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.plans import MODULES, reads
from pulsegrid.plans.bindings import Lake

READS: dict[str, tuple[str, ...]] = {
    "dashboard/overview": ("agg_e6", "agg_d1"),
    "dashboard/ai-penetration": ("st_14",),
    "dashboard/token-trend": ("fn_g1",),
    "dashboard/insight-audit": ("agg_s9",),
    "dashboard/online": ("jn_19", "srt_12"),
    "dashboard/top-projects": ("agg_p1",),
    "dashboard/top-employees": ("srt_1", "jn_17"),
    "people": ("jn_16", "agg_d6", "agg_d7", "jn_20"),
    "people/one": ("agg_e16", "agg_e17", "agg_m8", "agg_c6"),
    "people/one/slash-commands": ("agg_m10_user",),
    "projects": ("agg_p1", "jn_18"),
    "projects/one": ("agg_e11", "agg_e12", "agg_e13"),
    "models/distribution": ("agg_e10", "fn_g7"),
    "models/heatmap": ("fn_g2", "srt_7"),
    "stats/tools": ("agg_e1",),
    "admin/capability/ranking": ("fn_g8", "fn_g8_mcp"),
    "admin/capability/trend": ("agg_c4",),
    "admin/capability/matrix": ("fn_g3",),
    "admin/attribution/trend": ("agg_g3", "fn_g5"),
    "admin/attribution/pivot": ("fn_g4", "agg_g4"),
    "admin/attribution/penetration-check": ("st_14",),
    "admin/analysis": ("mat_4",),
    "ai-sessions": ("srt_5",),
    "ai-sessions/messages": ("srt_3",),
}


def read(spark: SparkSession, path: str, folder: str) -> dict[str, DataFrame]:
    """The tables that answer ``path``, by the names of their queries; nothing is computed before it is used."""
    known = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return {name: known[name](spark, folder) for name in READS[path]}


def call(spark: SparkSession, folder: str, path: str, **parameters: object) -> DataFrame:
    """The answer to ``path`` with its parameters, for example ``call(spark, folder, "people/one", user="u7", first="1996-01-01")``."""
    return reads.answer(Lake(spark, folder), path, **parameters)
