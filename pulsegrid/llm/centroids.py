"""Clustering of integer vectors around centroids, with every assignment exact.

A vector's components become integers. In each round a float32 matrix product estimates all squared
distances of a batch at once, and a bound on its rounding error makes an interval of each estimate. A
centroid whose interval lies wholly above another's can not be the nearest; where one is left it
is the nearest, and the few rows with several are recomputed with integers, ties to the smaller number. Sums
of components are exact too: each task adds its own up and sends one row for each centroid and component.

The bound: with u = 2 ** -24 a float32 product of d terms, of numbers rounded to float32, is off by at most
g / (1 - g) * |x| * |c|, g = (d + 2) * u, in whatever order the terms are added. Where the product overflows,
the interval is unbounded and the integers decide.

Cases: vectors with another number of components, with a null, NaN or infinite one, or one beyond ``LIMIT`` after
scaling (its squares fit no decimal) are left out; null vectors too; a null id never starts a centroid while
there are others, but is assigned; repeated ids and vectors are rows of their own; with fewer vectors than ``k`` there are fewer
centroids; a centroid that loses all its vectors stays where it was; distances and sums that fit no long are
null; columns besides id and vector are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carrying import with_kept
from .staging import stage

LIMIT = 1 << 57  # 256 squares of differences of such numbers fit 38 digits
ROWS = 8_192  # rows of a matrix product
UNIT = 2.0**-24


def integers(vector: Column, dims: int, scale: int) -> tuple[Column, Column]:
    """floor(scale * component) for each component, and whether the vector is one to cluster."""
    wide = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = (F.size(vector) == dims) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT))
    return F.transform(wide, lambda x: F.floor(x)), F.coalesce(usable, F.lit(False))


def exact_squares(differences: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, as int64 where that is safe, else as Python integers."""
    if differences.size and max(int(differences.max()), -int(differences.min())) ** 2 * differences.shape[1] >= 1 << 63:
        differences = differences.astype(object)
    return (differences * differences).sum(axis=1)


def intervals(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of squared distance less the vector's own square, for each vector and centroid."""
    g = (vectors.shape[1] + 4) * UNIT
    wide, narrow = vectors.astype(np.float64), centroids.astype(np.float64)
    squares = (narrow * narrow).sum(axis=1)
    with np.errstate(all="ignore"):
        inner = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        off = 2 * g / (1 - g) * np.sqrt((wide * wide).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
        middle = squares[None, :] - 2 * inner
        off = off * (1 + 1e-9) + (squares[None, :] + 2 * np.abs(inner)) * 2.0**-45  # and what float64 itself rounds
        known = np.isfinite(middle)
    return np.where(known, middle - off, -np.inf), np.where(known, middle + off, np.inf)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid of each vector, and how many vectors integers had to decide."""
    low, high = intervals(vectors, centroids)
    open_ = low <= high.min(axis=1)[:, None]
    chosen = open_.argmax(axis=1)
    close = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(close):
        at, number = np.nonzero(open_[close])
        found = exact_squares(vectors[close[at]] - centroids[number])
        exact = np.full((len(close), len(centroids)), 1 << 200, object) if found.dtype == object else np.full((len(close), len(centroids)), np.iinfo(np.int64).max)
        exact[at, number] = found
        chosen[close] = exact.argmin(axis=1)  # the first of equal ones
    return chosen.astype(np.int32), len(close)


def matrices(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """Arrays of at most ``ROWS`` vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for i in range(0, len(flat), ROWS):
        yield flat[i : i + ROWS]


def sums_by_task(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each centroid with vectors in the task and each component: count and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for vectors in matrices(batch.column(0), dims):
                chosen, _ = nearest(vectors, centroids)
                order = np.argsort(chosen, kind="stable")
                numbers, first = np.unique(chosen[order], return_index=True)
                safe = np.abs(vectors).max() < 1 << 48
                totals[numbers] += np.add.reduceat(vectors[order] if safe else vectors[order].astype(object), first, axis=0).astype(object)
                counts += np.bincount(chosen, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [
                pa.array(np.repeat(some, dims), pa.int32()),
                pa.array(np.tile(np.arange(dims), len(some)), pa.int32()),
                pa.array(np.repeat(counts[some], dims), pa.int64()),
                pa.array([int(x) for x in totals[some].ravel()], pa.decimal128(38, 0)),
            ],
            names=["cluster", "at", "n", "total"],
        )

    return run


def assigned_by_task(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kept, cluster and exact distance of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for vectors in matrices(batch.column(1), centroids.shape[1]):
                chosen, _ = nearest(vectors, centroids)
                far = exact_squares(vectors - centroids[chosen])
                kept = batch.column(0).slice(done, len(vectors))
                done += len(vectors)
                yield pa.record_batch([kept, pa.array(chosen), pa.array([int(x) for x in far], pa.decimal128(38, 0))], names=["kept", "cluster", "far"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; k * dims rows reach the driver."""
    sums = vectors.select("ints").mapInArrow(sums_by_task(centroids), "cluster int, at int, n long, total decimal(38,0)")
    found = centroids.copy()
    for row in sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        found[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return found


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


@dataclass
class Clusters:
    """``rows``: id, cluster, distance, cluster_inertia, inertia, centroid_sha256; ``centroids``: one row of integers each."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> Clusters:
    """Assign every vector to one of ``k`` centroids after ``rounds`` rounds.

    The centroids start as the ``k`` vectors whose ids, as text after ``seed``, have the least SHA-256.
    """
    if not 0 < dims <= 256:
        raise ValueError("dims must be 1 to 256")
    ints, usable = integers(F.col(vector_col), dims, scale)
    rows = stage(vectors.where(usable).select(F.col(id_col), ints.alias("ints")), "vectors")
    start = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"), 256)
    first = rows.select("ints", start.alias("start")).orderBy(F.asc_nulls_last("start"), "ints").limit(k).collect()
    centroids = np.array([r["ints"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        shape = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in shape.split(", "))]
        return Clusters(rows.select(id_col, *none), centroids)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = stage(with_kept(rows, [id_col], {"ints": F.col("ints")}, assigned_by_task(centroids), "cluster int, far decimal(38,0)"), "assigned")
    inertia = {r["cluster"]: int(r["far"]) for r in found.groupBy("cluster").agg(F.sum("far").alias("far")).collect()}
    whole = sum(inertia.values())
    as_long = lambda n: n if n < 1 << 63 else None
    named = [(i, as_long(n), as_long(whole), digest(centroids[i])) for i, n in inertia.items()]
    table = found.sparkSession.createDataFrame(named, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(table), F.col("cluster") == F.col("_cluster"))  # at most k rows
    return Clusters(joined.select(id_col, "cluster", F.expr("try_cast(far as bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"), centroids)
