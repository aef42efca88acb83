"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v is math.nan or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df, columns):
    df = df[columns].astype(object)
    return sorted(tuple(norm(v) for v in r) for r in df.where(df.notna(), None).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_its_sql_gives(spark, duck, name):
    made = entry.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    want = duck.execute(SQL[name]).df()
    assert sorted(want.columns) == columns
    assert rows(made.toPandas(), columns) == rows(want, columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "n"]
