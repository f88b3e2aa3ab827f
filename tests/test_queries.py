"""Every catalog query against its SQL oracle."""

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_oracle(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["offset", "key", "error_value", "purchase_value"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark):
    plan = catalog.filter_value(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
    assert "props" not in plan.split("ReadSchema")[1]
