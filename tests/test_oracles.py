"""Every registered query against its DuckDB form on the smallest data set."""
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from maskloom.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered(df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    index = [names.index(c) for c in columns]
    assert rows == ordered([tuple(r[i] for i in index) for r in result.fetchall()])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
