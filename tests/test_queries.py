"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from wiretide.plans import bodies, content, extras, timeline, traffic, web, wire  # noqa: F401
from wiretide.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(v) if isinstance(v, pd.Timestamp) else round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    want = duck.sql(SQL[name]).df()
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got.toPandas(), columns) == rows(want, columns)
