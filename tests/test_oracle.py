"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans.base import NAMES
from geoloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype.kind
        if kind == "M" or (kind == "O" and len(out) and type(out[c].iloc[0]).__name__ in ("date", "Timestamp", "datetime")):
            out[c] = pd.to_datetime(out[c]).astype(str)
        elif kind in "fiu" or str(out[c].dtype).startswith(("Int", "Float")):
            out[c] = [None if pd.isna(v) else round(float(v), 5) + 0.0 for v in out[c]]
    return sorted(map(str, out.astype(object).where(out.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) and len(got)
