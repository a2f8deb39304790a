"""Every named query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    got = _rows(plans.queries()[name](spark, SF).toPandas())
    assert got == _rows(duck.execute(plans.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
