"""Every query of the registry against its SQL on DuckDB, at the smallest scale."""

import decimal

import duckdb
import pytest

from gleanworks import catalog, plans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        return
    result = duck.sql(catalog.ORACLES[name])
    at = [result.columns.index(c) for c in columns]
    assert sorted(result.columns) == columns
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
