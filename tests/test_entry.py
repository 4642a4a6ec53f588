"""Every query that has SQL gives the same rows, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from fieldbook.plans import catalog


@pytest.fixture(scope="module")
def database(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf, database, name):
    frame = catalog.QUERIES[name](spark, sf)
    found = database.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(names, found.fetchall())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.FLAGSHIP in __spark_entry__.queries()
