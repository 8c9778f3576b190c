"""What a row needs is made once, small files are dealt out, and ties and empty ranges follow the rule that is documented."""

import duckdb
from pyspark.sql import functions as F

from geoloom.operators import evaluation, rings
from geoloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_made_once_a_text(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a b c x")], "id long, ref string, hyp string")
    scores = evaluation.rouge_n(rows, "id", "ref", "hyp", 2)
    assert plan(scores).count("split(") == 2 and scores.first()["f1"] == 2 * 2 / 6


def test_centroids_are_made_once(spark):
    text = plan(QUERIES["geom_point_inside"](spark, DATA))
    assert "RepartitionByExpression" in text and "middle" in text


def test_small_files_are_dealt_out(spark, monkeypatch):
    assert "RepartitionByExpression" in plan(QUERIES["geom_buffer_point"](spark, DATA))


def test_filled_runs_are_not_broadcast(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    layer = spark.createDataFrame([(i, ring, i % 3) for i in range(6)], "id long, ring array<struct<x:double,y:double>>, v int")
    cells = rings.rasterized(layer, "id", "v", F.col("id"))
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
    assert {(r["r"], r["c"]): r["value"] for r in cells.collect()} == {(y, x): 2 for y in range(4) for x in range(4)}


def test_sql_of_an_empty_range(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 'A' AS l_returnflag, 5 AS l_orderkey, 7 AS l_partkey, 9 AS l_quantity")
    assert con.sql(ORACLE_SQL["rescale_minmax"]).fetchall() == [("A", 5, 7, 0.0, 0)]


def test_sql_of_equal_distances():
    """Two points of a path equally far from its ends: the first one parts it."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 1 AS user_id, i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, [0.0, 9.0, 0.0, 9.0, 0.0][i + 1] AS value FROM (SELECT unnest(range(0, 5)) AS i)")
    assert con.sql(ORACLE_SQL["geom_simplify_tolerance"]).fetchall() == [(1, 5, 3, 5)]
    assert "arg_max(i, (d, -i))" in ORACLE_SQL["geom_simplify_tolerance"]
