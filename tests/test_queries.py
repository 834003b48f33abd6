"""Every registered inventory query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from aeroflux.plans import catalog
from aeroflux.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(rows, columns):
    """Rows in column-name order, numbers as floats."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: x if x is None or isinstance(x, str) else str(x) if not isinstance(x, (int, float)) and not hasattr(x, "as_tuple") else float(x)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y) if all(isinstance(v, float) for v in x) else [v if not isinstance(v, float) else pytest.approx(v, rel=1e-6, abs=1e-6) for v in y] == list(x)
