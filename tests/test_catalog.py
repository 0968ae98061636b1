"""Every query runs; those with SQL give the rows that an independent engine gives."""

import os

import pytest

import __spark_entry__ as entry
from glyphloom.plans import catalog


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


def same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    a = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    b = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert a == b


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.SQL:
        same(df, connect(sf), catalog.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["token", "in_weight", "log_p"] and df.count() == 20
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
