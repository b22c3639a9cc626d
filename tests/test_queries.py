"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    r = duck.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.select(*names).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
