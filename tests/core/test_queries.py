"""Every query with SQL against DuckDB, on the small tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest

import __spark_entry__
from tests.conftest import DATA
from windgrid.plans.catalogue import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    expected = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
