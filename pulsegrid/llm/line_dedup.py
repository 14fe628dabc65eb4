"""Line deduplication over whole documents.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, and the
lines of hashes over the threshold are dropped everywhere but in one document. Only hashes and
positions are grouped; the text moves once, to meet the positions that its document loses, or not at all
where the table of losses is small enough for Spark to broadcast it. Very common lines don't meet in a task:
their hashes are broadcast (see ``hot_keys``).

Cases: a null or empty text is one empty line; a line that repeats within a document counts once for
it; rows that repeat an id count as one document, and each loses its own lines; rows with a null id
are neither counted nor changed; a text of very many lines is one array of lines in one task; extra
columns are kept whatever their names, but columns n_lines and n_dropped are replaced by the results; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carrying import packed, quoted
from .hot_keys import join_groups
from .native import ascii_lower
from .staging import stage

BLANKS = " \t\n\x0b\x0c\r"
RESULT = ("n_lines", "n_dropped")


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: stripped of ASCII blanks, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def lines_to_drop(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, digest, drops: positions to drop) for documents that lose lines; rows has id, digest and text."""
    lines = (
        rows.where("id is not null")
        .select("id", "digest", F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
        .where(F.length("key") >= min_chars)
        .select("id", "digest", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    lines = stage(lines, "lines")
    holders = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    common = holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    common = stage(common.select("h1", "h2", "keeper", "n"), "common_lines")
    lost = join_groups(lines, common, ["h1", "h2"], F.col("n"), lines.count()).where("id < keeper")
    return lost.groupBy("id", "digest").agg(F.collect_set("at").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and the columns n_lines and n_dropped added.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents stays only in
    the largest id that holds it.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    others = [c for c in keep if c != text_col]
    rows = docs.select(packed(docs, others).alias("kept"), F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    drops = stage(lines_to_drop(rows, min_chars, min_docs), "lost_lines")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    found = rows.join(drops.withColumnsRenamed({"id": "of", "digest": "its"}), (F.col("id") == F.col("of")) & (F.col("digest") == F.col("its")), "left")
    found = found.withColumn("lines", F.when(F.col("drops").isNotNull(), lines))
    return found.select(
        *[F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias(c) if c == text_col else F.col(f"kept.c{others.index(c)}").alias(c) for c in keep],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
