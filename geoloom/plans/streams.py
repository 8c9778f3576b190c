"""The scheduled jobs as streams over events; the batch form of each is its check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.events import filled, latest, rocksdb, run_to_end, table_stream
from .base import Tables, query


def _events(t: Tables, *columns: str) -> DataFrame:
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), *columns)


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'view'")
def stream_scene_ingest(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, _events(t, "event_id", "user_id", "event_type"), "scenes")
    return run_to_end(stream.where("event_type <> 'view'").select("event_id", "user_id"), "append", "ingested")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_scene_dedupe(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, _events(t, "user_id", "event_type"), "catalogue")
    return run_to_end(stream.withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "append", "deduped")


@query("SELECT date_trunc('month', ts) AS month, event_type, count(*) AS n, round(sum(value), 4) AS area FROM events GROUP BY 1, 2")
def stream_monthly_area(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, _events(t, "event_type", "value"), "months").withWatermark("ts", "1 day")
    sums = stream.groupBy(F.date_trunc("month", "ts").alias("month"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("area"))
    done = latest(run_to_end(sums, "update", "monthly"), ["month", "event_type"])
    return done.select(F.col("month").cast("timestamp_ntz").alias("month"), "event_type", "n", F.round("area", 4).alias("area"))


@query("""WITH w AS (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS first FROM events)
SELECT first, event_type, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""")
def stream_sliding_index(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, _events(t, "event_type", "value"), "series").withWatermark("ts", "1 day")
    means = stream.groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.avg("value").alias("mean")).select(F.col("window.start").alias("first"), "event_type", "mean")
    done = latest(run_to_end(means, "update", "sliding"), ["first", "event_type"])
    return done.select(F.col("first").cast("timestamp_ntz").alias("first"), "event_type", F.round("mean", 6).alias("mean"))


@query("SELECT event_type, CAST(user_id % 4 AS BIGINT) AS pred, count(*) AS n, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1, 2")
def stream_running_metrics(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, _events(t, "event_type", "user_id", "value"), "metrics")
    sums = stream.groupBy("event_type", (F.col("user_id") % 4).cast("long").alias("pred")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return latest(run_to_end(sums, "update", "running"), ["event_type", "pred"]).select("event_type", "pred", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@query("""SELECT user_id, event_id, round(last_value(CASE WHEN value > 5 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS filled FROM events""")
def stream_gap_fill(t: Tables) -> DataFrame:
    """A row of no user ends the stream, later than all, so that the watermark passes every event."""
    events = _events(t, "event_id", "user_id", "value")
    last = events.agg(F.max("ts").alias("ts")).where("ts is not null")  # one row
    end = last.select((F.col("ts") + F.expr("interval 1000 days")).alias("ts"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c != "ts"])
    stream = table_stream(t.spark, events, "cells", end=end).withColumn("clear", F.when(F.col("value") > 5, F.col("value").cast("double")))
    with rocksdb(t.spark):
        found = run_to_end(filled(stream, "10 days"), "append", "filled")
    return found.where("user_id is not null or event_id is not null").select("user_id", "event_id", F.round("filled", 6).alias("filled"))
