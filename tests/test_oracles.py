"""Every registered warehouse query against its DuckDB SQL on the smallest tables."""

import math
import os

import pytest

from pulsefleet import oracles, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def cell(x):
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(cell(x) for x in r) for r in df.select(*columns).collect())
    assert got == sorted(tuple(cell(x) for x in r) for r in want.fetchall())
    assert got or name in ("correlate_lag", "streaks", "anomalies")
    assert not any(math.isinf(x) for r in df.limit(5).collect() for x in r if isinstance(x, float))
