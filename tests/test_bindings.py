"""Every query with SQL against DuckDB."""

import os

import duckdb
import pytest

from lodestone.plans import bindings


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, sf, duck, name):
    df = bindings.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    if name in bindings.ORACLES:
        rel = duck.sql(bindings.ORACLES[name])
        columns = list(rel.columns)
        assert sorted(columns) == names
        assert rows == sorted(str([plain(r[columns.index(c)]) for c in names]) for r in rel.fetchall())
    else:
        assert rows
