"""Every registered query with SQL gives what DuckDB gives for it, at the smallest scale."""

import math

import duckdb
import pytest

from sieveline.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    result = QUERIES[name](spark, sf)
    columns = sorted(result.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    expected = duck.execute(ORACLES[name])
    order = [c[0] for c in expected.description]
    assert sorted(order) == columns
    assert rows == sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in expected.fetchall()), key=repr)
