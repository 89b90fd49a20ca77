import importlib
import os

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    as_rows = lambda f: sorted(map(tuple, f[columns].astype(str).values))
    assert as_rows(want) == as_rows(got)
