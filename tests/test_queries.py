"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from dosewise.plans.queries import QUERIES
from dosewise.plans.sql import SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = tidy(got), tidy(want)
    assert len(a) == len(b) and (len(a) or name == "hwe_fail_counts")
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), len(a), bad[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count()
