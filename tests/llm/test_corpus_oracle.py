"""The corpus queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from geoloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert set(want.columns) <= set(got.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    rows = lambda frame: sorted(str([plain(v) for v in r]) for r in frame[list(want.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
