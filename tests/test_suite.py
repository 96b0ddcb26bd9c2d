"""Every registered query equals its SQL twin on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidepair import suite

SF_DIR = "/root/testdata/sf0.001"
TABLES = "customer events orders lineitem supplier".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in pdf.itertuples(index=False))


QUERIES, SQL = suite.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_holds_every_query():
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
