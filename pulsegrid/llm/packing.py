"""Length buckets with least padding, and token-budget batches inside them.

The global histogram of lengths decides the bucket boundaries by dynamic programming. Texts longer
than ``max_len`` tokens are cut into pieces of ``max_len`` and a rest, so the histogram has at most
``max_len`` rows and no token is lost.

Cases: null and empty texts have one piece of 0 tokens, in no bucket (bucket -1, no batch), and are not shuffled; ties in
the order have the same length and are interchangeable; a text longer than ``max_len`` is cut into pieces; an empty
table gives an empty result; null ids are carried; extra columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .staging import stage


def count_tokens(text: Column) -> Column:
    """Blank-separated tokens; give another expression for a subword count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` upper bounds for which the total padded length is least.

    best[j] is the least cost of the first j lengths; a bucket over lengths i..j-1 costs the last of
    them for each row.
    """
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    top = lengths.astype(np.float64)
    cost = top[None, :] * (total[None, 1:] - total[:-1, None])  # cost[i, j]: one bucket over i..j
    cost[np.tril_indices(n, -1)] = np.inf
    best, cuts = cost[0], []
    for _ in range(1, min(k, n)):
        split = best[:-1, None] + cost[1:, :]  # the last bucket starts at i + 1
        cut = split.argmin(axis=0)
        cuts.append(np.where(split.min(axis=0) < best, cut, -1))
        best = np.minimum(best, split.min(axis=0))
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(lengths[j]))
            j = cut[j]
    return sorted([*bounds, int(lengths[j])])


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_tokens: Column | None = None,
    max_len: int = 2048,
    buckets: int = 8,
    token_budget: int = 16_384,
    rows_per_shard: int = 50_000,
) -> DataFrame:
    """One row per piece: id, piece, start (first token), n_tokens, bucket, bucket_len, batch_id, slot.

    A batch of a bucket holds ``token_budget // bucket_len`` rows, at least one. Rows are numbered
    within hashed shards of about ``rows_per_shard`` rows, and the shards' sizes give each shard its
    offset, so that only the last batch of a bucket is short and no task sees a whole bucket.
    """
    tokens = count_tokens(F.col(text_col)) if n_tokens is None else n_tokens
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_all") / max_len))
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), tokens.cast("long").alias("_all"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    start = F.col("piece") * max_len
    every = stage(rows.select(id_col, "_row", "piece", start.alias("start"), F.least(F.lit(max_len), F.col("_all") - start).alias("n_tokens")), "pieces")
    empty = every.where("n_tokens = 0").select(id_col, "piece", "start", "n_tokens", F.lit(-1).alias("bucket"), *[F.lit(None).cast("long").alias(c) for c in ("bucket_len", "batch_id", "slot")])
    rows = every.where("n_tokens > 0")
    hist = rows.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").toPandas()  # at most max_len rows
    bounds = optimal_buckets(hist["n_tokens"].to_numpy(), hist["count"].to_numpy(), buckets) if len(hist) else [max_len]
    inside = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(inside, lambda b: b < F.col("n_tokens")))
    shards = max(1, -(-int(hist["count"].sum()) // rows_per_shard))
    placed = rows.withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))
    placed = placed.withColumn("bucket_len", F.get(inside, F.col("bucket")))
    before = W.partitionBy("bucket").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "_shard").count().select("bucket", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    at = F.row_number().over(W.partitionBy("bucket", "_shard").orderBy("_row", "piece")) - 1 + F.col("_offset")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    found = placed.join(offsets, ["bucket", "_shard"]).withColumn("_at", at)
    found = found.select(id_col, "piece", "start", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_at") / per_batch).alias("batch_id"), (F.col("_at") % per_batch).cast("long").alias("slot"))
    return found.unionByName(empty)
