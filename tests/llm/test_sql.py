"""Training-data queries that SQL expresses, against DuckDB on the same tables."""

import glob
import numbers
import os

import duckdb
import pytest

from themeloom.llm import queries


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(repr(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
