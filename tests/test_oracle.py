"""Every registered query against its DuckDB oracle at the smallest scale (the driver runs sf0.01)."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

from locations import SF_SMALL

TABLES = ["documents", "pages", "conversations", "labels", "benchmark"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else (str(int(v)) if v.is_integer() else repr(round(v, 6)))
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    d = con.sql(E.oracle_sql()[name]).df()
    assert _rows(s) == _rows(d)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"project", "action", "n_files"}
