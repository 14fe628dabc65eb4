"""Every registered query against its DuckDB SQL on the smallest tables."""

import datetime
import math
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from pulsegrid.plans import MODULES

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


@pytest.fixture(scope="module")
def rows(spark):
    """Columns and rows of every query, several at once; an error is kept for the query's own test."""

    def run(name):
        try:
            df = QUERIES[name](spark, SF)
            columns = sorted(df.columns)
            return columns, [tuple(plain(r[c]) for c in columns) for r in df.collect()]
        except Exception as error:
            return error

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


def found(rows, name):
    if isinstance(rows[name], Exception):
        raise rows[name]
    return rows[name]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(rows, duck, name):
    columns, got = found(rows, name)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(rows, name):
    assert found(rows, name)[1]
