"""Every query with SQL agrees with DuckDB, row by row."""

import math

import duckdb
import pytest

from chronoweave.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    theirs = sorted(tuple(value(r[i]) for i in order) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship():
    assert FLAGSHIP in ORACLE_SQL
