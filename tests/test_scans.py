"""Percentiles and scans of groups that hold most rows, many ties and odd values, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import evaluation, orders
from geoloom.operators.quantiles import percentiles


def test_percentiles_of_odd_groups(spark):
    rng = random.Random(41)
    groups = {
        "ties": [7.0] * 5000 + [-3.5] * 40,
        "signs": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)],
        "near": [1.0 + k * 2**-52 for k in range(700)],
        "small": [5e-324, -5e-324, 0.0, -0.0, 1e-310],
        "one": [42.0],
        None: [float(k % 13) for k in range(500)],
        "huge": [float("inf"), float("-inf"), 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    got = {r["k"]: (r["n"], r["p"]) for r in percentiles(df, ["k"], "v", shares).collect()}
    want = {r["k"]: (r["n"], r["p"]) for r in df.where("v is not null").groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", shares).alias("p")).collect()}
    assert set(got) == set(want) == set(groups)
    for k in groups:
        assert got[k][0] == want[k][0]
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[k][1], want[k][1], strict=True)), k


def test_percentiles_of_few_steps_and_nan(spark):
    values = [float(k) ** 3 for k in range(-300, 300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = percentiles(df, [], "v", [0.1, 0.5, 0.77], steps=3).first()["p"]
    assert got == pytest.approx(np.quantile(values, [0.1, 0.5, 0.77]).tolist(), rel=1e-12)
    with_nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    p = percentiles(with_nan, [], "v", [0.0, 0.5, 1.0]).first()["p"]
    assert p[:2] == [1.0, 2.0] and math.isnan(p[2])
    assert percentiles(df.limit(0), [], "v", [0.5]).isEmpty()


def test_quantile_of_ties(spark):
    df = spark.createDataFrame([(5,)] * 900 + [(1,)] * 50 + [(9,)] * 50 + [(None,)], "v int")
    values = [1] * 50 + [5] * 900 + [9] * 50
    for share in (0.0, 0.049, 0.0495, 0.5, 0.951, 1.0):
        assert orders.quantile(df, "v", share) == pytest.approx(float(np.quantile(values, share)))
    assert orders.quantile(df.limit(0), "v", 0.5) is None


@pytest.fixture(scope="module")
def predictions(spark):
    """One class of most rows, some small ones, one of a single row, one null."""
    rng = random.Random(42)
    rows = [("hot", rng.random(), int(rng.random() < 0.3), i) for i in range(6000)]
    rows += [(f"c{i % 30}", round(rng.random(), 1), int(rng.random() < 0.5), 10_000 + i) for i in range(600)] + [("one", 0.5, 1, 1), (None, 0.2, 1, 2), (None, 0.3, 0, 3), ("no", 0.5, 0, 4)]
    return rows, spark.createDataFrame(rows, "cls string, score double, correct int, n int")


def by_class(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[1], r[3])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[1, 16])
def parts(spark, request):
    """So many parts of the range deal."""
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_ranks_and_sums_within_groups(spark, predictions, parts):
    rows, df = predictions
    r = orders.running(df, [F.desc("score"), F.col("n")], {"tp": F.col("correct")}, by=["cls"], keep_part=True)
    got = {(x["cls"], x["n"]): (x["_rank"], x["tp"]) for x in r.collect()}
    if parts == 16:
        assert r.where("cls = 'hot'").select("_part").distinct().count() > 8  # the great class is many tasks' work
    for cls, own in by_class(rows).items():
        total = 0
        for k, x in enumerate(own):
            total += x[2]
            assert got[cls, x[3]] == (k, total)


def test_average_precision_of_a_great_class(spark, predictions, parts):
    rows, df = predictions
    r = evaluation.ranked(df, "cls", [F.desc("score"), F.col("n")])
    got = {x["cls"]: x["ap"] for x in evaluation.average_precision(r, "cls").collect()}
    coarse = {x["cls"]: x["ap"] for x in evaluation.average_precision_101(r, "cls").collect()}
    for cls, own in by_class(rows).items():
        tp = np.cumsum([x[2] for x in own])
        if not tp[-1]:
            assert cls not in got and cls not in coarse
            continue
        best = np.maximum.accumulate((tp / np.arange(1, len(own) + 1))[::-1])[::-1]
        recall = tp / tp[-1]
        assert got[cls] == pytest.approx(sum(b for b, x in zip(best, own, strict=True) if x[2]) / tp[-1])
        at = [max((b for b, r in zip(best, recall, strict=True) if r * 100 >= i - 1e-9), default=0.0) for i in range(101)]
        assert coarse[cls] == pytest.approx(sum((a + b) / 2 for a, b in zip(at[:-1], at[1:], strict=True)) / 100)
