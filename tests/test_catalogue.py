"""Every catalogue query that SQL expresses, against DuckDB on the same tables."""

import glob
import numbers
import os

import duckdb
import pytest

from themeloom.plans import catalogue


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, data, duck, name):
    got, want = catalogue.queries()[name](spark, data).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
