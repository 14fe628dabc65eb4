"""Joins with a table of groups whose sizes are known, with no group's rows in one task.

Of all rows at most ``HOT`` groups can hold more than one in ``HOT`` of them. Those groups are broadcast, which
their number bounds whatever the input is; the rows of all others meet their group by a shuffle of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 2_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: Column, n_rows: int, least: int = 1_000) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row for each of ``keys``.

    ``size``: how many rows a group has, as a column of ``groups``; ``n_rows``: their sum over all groups, or more.
    """
    bound = max(least, n_rows // HOT)
    others = [c for c in groups.columns if c not in keys]
    hot = groups.where(size > bound).select(*keys, F.struct(*others).alias("_hot"))
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    by_hot = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in others])
    rest = marked.where("_hot is null").drop("_hot").join(groups.where(size <= bound), list(keys))
    return by_hot.unionByName(rest.select(*rows.columns, *others))
