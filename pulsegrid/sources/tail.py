"""Lines of growing files, each read once (SRC-17, 18, 19).

``cursors`` (file, size, mtime, offset) say how far each file was read. A file that has not changed is not opened; one that
has grown is read on from its offset; one that is shorter than before is read anew. A last line without an end is left for
the next time, a line of over ``most_bytes`` is skipped. Files are listed by Spark and read in tasks; a file is one task's work,
in pieces of bounded size. For use where the executors can open the files, as a collector's are.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CURSOR = "file string, size bigint, mtime timestamp, offset bigint"
PIECE = 1 << 20


def listed(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, size, mtime) of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def fresh_groups(files: DataFrame, group: str, cutoff: str) -> DataFrame:
    """SRC-18: files of groups (a capture of the path) of which any file was changed since ``cutoff``."""
    key = F.regexp_extract("file", group, 1)
    newest = F.max("mtime").over(W.partitionBy("_group"))
    return files.withColumn("_group", key).withColumn("_newest", newest).where(F.col("_newest") >= F.lit(cutoff).cast("timestamp")).drop("_group", "_newest")


def due(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """SRC-19: files that need reading, and from which offset."""
    old = cursors.select("file", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("offset").alias("_offset"))
    both = files.join(old, "file", "left").where("_mtime is null or _mtime <> mtime")
    grown = F.col("size") > F.coalesce("_size", F.lit(0))
    return both.select("file", "size", "mtime", F.when(grown, F.coalesce("_offset", F.lit(0))).otherwise(0).cast("long").alias("offset"))


def whole_lines(path: str, offset: int, most_bytes: int) -> Iterator[tuple[bytes | None, int]]:
    """(line, the offset after it) for every line that is ended; None for one that is too long."""
    with Path(path).open("rb") as file:
        file.seek(offset)
        kept, skipped = b"", False
        while piece := file.read(PIECE):
            parts = (kept + piece).split(b"\n")
            kept = parts.pop()
            for line in parts:
                offset += len(line) + 1
                yield (None if skipped or len(line) > most_bytes else line.removesuffix(b"\r"), offset)
                skipped = False
            if len(kept) > most_bytes:  # its bytes are let go, its place is kept
                offset, kept, skipped = offset + len(kept), b"", True


def read(files: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """(file, offset, value) for each whole line of ``due`` files; offset is where the line ends. Null values are skipped lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, offset in zip(batch["file"], batch["offset"]):
                rows, size = [], 0
                for line, end in whole_lines(unquote(urlparse(file).path), offset, most_bytes):
                    rows.append((file, end, None if line is None else line.decode(errors="replace")))
                    size += len(line or b"")
                    if size > PIECE:
                        yield pd.DataFrame(rows, columns=["file", "offset", "value"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["file", "offset", "value"])

    return files.select("file", "offset").repartition("file").mapInPandas(run, "file string, offset bigint, value string")


def advanced(files: DataFrame, lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """The cursors after ``lines`` were stored: files read have new ones, files that are gone have none."""
    ends = lines.groupBy("file").agg(F.max("offset").alias("_end"))
    old = cursors.select("file", F.col("offset").alias("_offset"), F.col("size").alias("_size"))
    both = files.join(ends, "file", "left").join(old, "file", "left")
    kept = F.when(F.col("size") >= F.coalesce("_size", F.lit(0)), F.coalesce("_offset", F.lit(0))).otherwise(0)
    return both.select("file", "size", "mtime", F.coalesce("_end", kept).cast("long").alias("offset"))
