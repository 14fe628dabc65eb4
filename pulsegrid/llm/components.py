"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def star(pairs: DataFrame) -> DataFrame:
    """For every (u, v): (v, least neighbour of u). ``pairs`` has each u with itself too.

    The least neighbours are combined before the shuffle and staged, so that the join can split the
    rows of a hub with very many neighbours.
    """
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("root")), "least")
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("root").alias("v"))


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v): root is the least node it can reach.

    Repeated and reversed links and links of a node to itself change nothing; null ends are dropped.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    links = links.where("u is not null and v is not null").select(u.alias("u"), v.alias("v"))
    alone = links.select("u").union(links.select("v")).distinct()
    links = stage(links.where("u > v").distinct(), "links")
    before = None
    while (now := state(links)) != before:
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        itself = both.select("u", F.col("u").alias("v"))
        large = star(both.union(itself).distinct()).where("u > v")
        large = stage(large.distinct(), "large")
        small = star(large.union(large.select("u", F.col("u").alias("v"))).distinct()).where("u > v")
        links = stage(small.distinct(), "links")
    return alone.join(links, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
