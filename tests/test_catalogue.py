"""Every query with SQL gives what DuckDB gives on the same tables; the others give their rows."""

import duckdb
import pandas as pd
import pytest

from keyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
