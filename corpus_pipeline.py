"""The corpus pipeline: five operators, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again before the next
one begins, so each stage first deletes the tables that the stage before it staged on its way. Nobody else's are touched.
All but the last return the columns of ``documents``, and no stage reads others, so extra columns of any name are left out. A removed row is found by its id and the digest of its text,
so rows that repeat an id are each judged; rows with a null id are only removed by what their own
text says. Very long texts are handled as each operator says; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from pulsegrid.llm.staging import drop, stage, tracking

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def digest() -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and digest are in ``removed`` (columns doc_id, digest)."""
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_gone")).distinct()
    return docs.withColumn("_digest", digest()).join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_gone") == F.col("_digest")), "left_anti").select(COLUMNS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
staged_before: list[str] = []


def tidy(function: Stage) -> Stage:
    """A stage that begins by deleting what the stage before it staged, whose result is written by now."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, staged_before)
        staged_before.clear()
        with tracking() as made:
            found = function(spark, docs.select(COLUMNS), sf_dir)
        staged_before.extend(made)
        return found

    return run_stage


@tidy
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or without a language that makes up half of them, go.

    Nothing is said of texts of under three bytes, which have no trigram, and of any text if no row has a language; those stay.
    """
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    if not model.languages:
        return docs.select(COLUMNS)
    found = language_id.identify(docs.select("doc_id", "text", digest().alias("digest"), F.octet_length("text").alias("bytes")), model)
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < 0.5) & (F.col("bytes") > 2)
    return without(docs, stage(found.where(rejected).select("doc_id", "digest"), "rejected"))


@tidy
def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that three documents or more hold; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@tidy
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the least id stays."""
    rule = jaccard_join.Rule(words=5, num=80, den=100)
    found = jaccard_join.jaccard_components(docs, rule=rule)
    gone = stage(found.where("component_id < doc_id").select(F.col("doc_id").alias("_id")).distinct(), "similar")
    return docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti").select(COLUMNS)


@tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a twentieth of their words in test passages go."""
    marked = docs.select("doc_id", "text", digest().alias("digest"))
    found = decontaminate.decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id", "digest"])
    return without(docs, stage(found.where("contaminated").select("doc_id", "digest"), "contaminated"))


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every piece of every document in its length bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", keep_one_of_similar),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Language mixtures and optimal buckets are not SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES:
        found = function(spark, docs, sf_dir)
        with tracking() as made:
            docs = stage(found, f"pipeline_{name}")
        drop(spark, before)
        before = made
    return docs
