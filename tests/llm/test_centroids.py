"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from pulsegrid.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, far int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    middle = [v for _, v in sorted(kept, key=lambda r: ((r[0] is None), sha(f"3:{r[0]}"), r[1]))][:k]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    best = lambda v: min((far(v, c), i) for i, c in enumerate(middle))
    for _ in range(rounds):
        own = [[] for _ in middle]
        for _, v in kept:
            own[best(v)[1]].append(v)
        middle = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, middle)]
    found = [(i, best(v)) for i, v in kept]
    each = [sum(d for _, (d, j) in found if j == c) for c in range(len(middle))]
    return sorted(((i, j, d, each[j], sum(each), sha(",".join(map(str, middle[j])))) for i, (d, j) in found), key=repr)


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).rows.collect()), key=repr)


@pytest.mark.parametrize("spread", [1, 0.002, 300])
def test_matches_plain(spark, spread):
    """Wide vectors, vectors of a few integers only (many ties), and large ones."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.4) * spread for _ in range(5)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 400)] + [(rows[5][0], rows[5][1]), (None, rows[6][1])]
    rows += [(500, None), (501, []), (502, [0.0] * 4), (503, [0.0] * 6), (504, [1.0, None, 0.0, 0.0, 0.0]), (505, [math.nan] + [0.0] * 4), (506, [math.inf] + [0.0] * 4), (507, [-0.0] * 5)]
    assert clustered(spark, rows, dims=5, k=8, rounds=4) == plain(rows, 5, 8, 4)


def test_hugely_different_sizes(spark):
    """Components whose squares fit no long: exact all the same, null where a long can not say it."""
    rows = [(1, [2.0**40, 3.0]), (2, [2.0**40, 4.0]), (3, [-(2.0**40), 3.0]), (4, [1.0, 1.0]), (5, [2.0**47, 0.0]), (6, [2.0**60, 0.0])]
    got = clustered(spark, rows, dims=2, k=2, rounds=3)
    want = plain(rows[:5], 2, 2, 3)
    fits = lambda n: n if n < 1 << 63 else None
    assert got == sorted(((i, j, fits(d), fits(e), fits(t), s) for i, j, d, e, t, s in want), key=repr)
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_few_and_none(spark):
    assert clustered(spark, [(1, [1.0, 2.0]), (2, [5.0, 5.0])], dims=2, k=8) == plain([(1, [1.0, 2.0]), (2, [5.0, 5.0])], 2, 8, 1)
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA)).rows
    assert empty.count() == 0
    assert empty.dtypes == centroids.cluster(spark.createDataFrame([(1, [0.5] * 64, 1, "", 2)], SCHEMA)).rows.dtypes


def test_bounds_hold():
    """The true value lies in its interval, and integers decide the rows where intervals overlap."""
    rng = np.random.default_rng(3)
    for size in (3, 1 << 12, 1 << 25, 1 << 40):
        vectors, middle = rng.integers(-size, size, (500, 64)), rng.integers(-size, size, (9, 64))
        middle[4], middle[7] = middle[2], middle[2] + (np.arange(64) == 5)
        vectors[:50] = middle[2]
        low, high = centroids.intervals(vectors, middle)
        wide = vectors.astype(object)
        exact = np.array([[sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle.tolist()] for v in wide.tolist()], object)
        own = (wide * wide).sum(axis=1)[:, None]
        true = exact - own
        assert all(int(x) >= math.floor(lo) and int(x) <= math.ceil(hi) for x, lo, hi in zip(true.ravel(), low.ravel(), high.ravel()))
        chosen, close = centroids.nearest(vectors, middle)
        assert (chosen == exact.argmin(axis=1)).all() and close >= 50
