"""Extra columns through ``mapInArrow``: packed in one struct, so that no name can clash.

A column of the input that is named as a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one struct of fields c0, c1, ..."""
    fields = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.struct(*fields) if fields else F.lit(None).cast("boolean")


def unpacked(column: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{column}.c{i}").alias(c) for i, c in enumerate(columns)]


def with_kept(df: DataFrame, keep: Sequence[str], inputs: dict[str, Column], run: Callable[[Batches], Batches], result: str, names: dict[str, str] | None = None) -> DataFrame:
    """``keep`` and the columns of ``result`` (a DDL string), made by ``run`` from batches of kept and ``inputs``.

    ``run`` must hand on the column kept first. ``names`` renames result columns.
    """
    rows = df.select(packed(df, keep).alias("kept"), *[c.alias(n) for n, c in inputs.items()])
    found = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, {result}")
    made = [c for c in found.columns if c != "kept"]
    return found.select(*unpacked("kept", keep), *[F.col(c).alias((names or {}).get(c, c)) for c in made])
