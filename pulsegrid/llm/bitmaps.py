"""Bitmaps that tasks get with their code, to tell most rows from the few that matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(bits: DataFrame, width: int) -> np.ndarray:
    """The numbers ``bit`` below 2 ** width as a bitmap, 64 to a word; at most 2 ** (width - 6) rows reach the driver."""
    rows = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toPandas()
    packed = np.zeros(1 << (width - 6), np.int64)
    packed[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return packed
