"""Every query with SQL gives the rows of the SQL, on the smallest tables."""

from __future__ import annotations

import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from docgrain.plans import catalogue

DATA = os.environ.get("DOCGRAIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for file in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {file.name.split('.')[0]} AS SELECT * FROM '{file}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, connection, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = connection.execute(catalogue.ORACLE[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    want = sorted(tuple(plain(dict(zip(named, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)):
        assert catalogue.QUERIES[name](spark, DATA).count() >= 0
