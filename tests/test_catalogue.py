"""Each catalogue query against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from sortloom import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(catalogue.ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    expected = sorted((tuple(plain(row[order.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr) == expected


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
