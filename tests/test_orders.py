"""Global orders, samples, callers' own functions and learned operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry, indices
from geoloom.operators import detections, evaluation, learned, orders, raster, sampling, vectors
from geoloom.sources import files
from geoloom.streaming import events


def test_a_million_ranks_with_more_columns(spark):
    rows = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id", (F.col("id") % 7).alias("v"), F.lit("x").alias("_k"), F.repeat(F.lit("pad"), 5).alias("pad"))
    got = orders.running(rows, [F.col("k")], {"total": F.col("v")})
    s = got.agg(F.count_distinct("_rank").alias("d"), F.min("_rank").alias("a"), F.max("_rank").alias("b"), F.max("total").alias("t")).first()
    assert tuple(s) == (1_000_000, 0, 999_999, sum(i % 7 for i in range(1_000_000))) and got.columns[:5] == rows.columns


def test_running_totals_and_quantiles(spark):
    rng = random.Random(1)
    made = [(rng.randrange(50), i, rng.random()) for i in range(700)]
    rows = spark.createDataFrame(made, "k int, i int, v double").repartition(5)
    got = {r["i"]: (r["_rank"], round(r["t"], 9)) for r in orders.running(rows, [F.col("k"), F.col("i")], {"t": F.col("v")}).collect()}
    total = 0.0
    for rank, (_, i, v) in enumerate(sorted(made)):
        total += v
        assert got[i] == (rank, round(total, 9))
    for share in (0.0, 0.37, 0.95, 1.0):
        assert orders.quantile(rows, "v", share) == pytest.approx(np.quantile([m[2] for m in made], share))
    assert orders.quantile(rows.limit(0), "v", 0.5) is None and orders.running(rows.limit(0), [F.col("k")]).count() == 0


def test_downsample_keeps_its_share_in_every_run(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 3 > 0).alias("empty"), F.repeat(F.lit("y"), 30).alias("more"))
    full = sum(1 for i in range(200_000) if i % 3 == 0)
    kept = [sorted(r["k"] for r in sampling.downsample(rows.repartition(n), "k", "empty", 0.3).where("empty").collect()) for n in (3, 16)]
    assert kept[0] == kept[1] and len(kept[0]) == int(0.3 * full / (1 - 0.3))


def test_callers_function_on_padded_tiles(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 9, (23, 31)).astype(float)
    cells = spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(grid) if (r * c) % 11], "r int, c int, cls int")
    have = np.where([[(r * c) % 11 > 0 for c in range(31)] for r in range(23)], grid, np.nan)
    padded = np.pad(have, 2, constant_values=np.nan)
    around = lambda r, c: padded[r : r + 5, c : c + 5]
    for f, want in ((detections.median_around(2), np.nanmedian), (lambda tile: np.nanmax(np.lib.stride_tricks.sliding_window_view(tile, (5, 5)), axis=(2, 3), initial=-1.0), np.nanmax)):
        got = {(x["r"], x["c"]): x["result"] for x in detections.by_halo(cells, 7, 2, f).collect()}
        assert got == {(r, c): want(around(r, c)) for r in range(23) for c in range(31) if (r * c) % 11}


def test_callers_function_over_time(spark):
    rows = spark.createDataFrame([(i % 3, 10 * t + i, None if (i, t) == (4, 2) else float(i * t)) for i in range(6) for t in (2, 1, 3)], "cell int, t int, v double")
    got = {r["cell"]: (r["n"], r["result"]) for r in raster.over_time(rows, ["cell"], ["t"], "v", lambda v: np.nansum(v * np.arange(len(v)))).collect()}
    want = {}
    for cell in range(3):
        values = [v for _, v in sorted((10 * t + i, math.nan if (i, t) == (4, 2) else float(i * t)) for i in range(6) if i % 3 == cell for t in (2, 1, 3))]
        want[cell] = (6, np.nansum(np.array(values) * np.arange(6)))
    assert {c: n for c, (n, _) in got.items()} == {c: n for c, (n, _) in want.items()} and got[0][1] == want[0][1]


def test_own_index_formulas(spark):
    row = spark.createDataFrame([(3, 1), (2, -2)], "nir int, red int")
    bands = {"nir": F.col("nir"), "red": F.col("red")}
    values = lambda f: [r[0] for r in row.select(indices.expression(f, bands)).collect()]
    assert values("(nir - red) / (nir + red)") == [0.5, None] and values("-nir ** 2 + sqrt(4)") == [-7.0, -2.0]
    for bad in ("green + 1", "__import__('os')", "nir if red else 0", "nir.alias('x')"):
        with pytest.raises(ValueError, match="not a part"):
            indices.expression(bad, bands)


def test_point_inside_bent_shapes(spark):
    shapes = {1: [(0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10), (0, 0)], 2: [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], 3: [(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (1, 1), (1, 9), (0, 9), (0, 0)]}
    rows = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in s]) for i, s in shapes.items()], "id int, ring array<struct<x: double, y: double>>")
    p = geometry.point_inside(F.col("ring"))
    got = rows.select("id", geometry.contains(F.col("ring"), p["x"], p["y"]).alias("in"), p["x"].alias("x")).orderBy("id").collect()
    assert [r["in"] for r in got] == [True] * 3 and got[1]["x"] == 2.0


def test_breaks_and_zones(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(m, 0.3, 200) for m in (0, 5, 9)])
    rows = spark.createDataFrame([(s, i, float(x) + s) for s in (0, 100) for i, x in enumerate(v)] + [(0, -1, float("nan"))], "s int, i int, v double")
    for r in learned.zoned(rows, ["s"], "v", 3).collect():
        assert r["zone"] == (None if r["i"] < 0 else 1 + r["i"] // 200)
    values, weights = np.array([1.0, 2.0, 10.0, 11.0, 30.0]), np.array([5, 5, 2, 2, 1.0])
    assert learned.breaks(values, weights, 3).tolist() == [1, 1, 2, 2, 3] and learned.breaks(values[:1], weights[:1], 5).tolist() == [1]
    x = np.sort(rng.random(9))
    cost = lambda which: sum(((x[which == c] - x[which == c].mean()) ** 2).sum() for c in set(which.tolist()))
    brute = min(cost(np.repeat([1, 2, 3], [a, b - a, 9 - b])) for a in range(1, 8) for b in range(a + 1, 9))
    assert cost(learned.breaks(x, np.ones(9), 3)) == pytest.approx(brute)


def test_longest_common_subsequence(spark):
    rng = random.Random(3)
    pairs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(9))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for i in range(40)]

    def lcs(a, b):
        if not a or not b:
            return 0
        return 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    for r in evaluation.rouge_l(spark.createDataFrame(pairs, "id int, ref string, hyp string"), "id", "ref", "hyp").collect():
        a, b = pairs[r["id"]][1].split(), pairs[r["id"]][2].split()
        assert r["f1"] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    y = x + rng.normal(size=x.shape) * 0.3
    mean, projection = vectors.whitening(spark.createDataFrame([(a, b) for a, b in zip(x.tolist(), y.tolist())], "x array<double>, y array<double>").repartition(7), "x", "y")
    d = x - y
    assert np.allclose(mean, x.mean(axis=0))
    assert np.allclose(projection @ (d.T @ d / len(d)) @ projection.T, np.eye(5), atol=1e-6)
    second = projection @ np.cov(x.T, bias=True) @ projection.T
    assert np.allclose(second, np.diag(np.diag(second)), atol=1e-6) and (np.diff(np.diag(second)) <= 1e-9).all()


def test_documents_hold_a_bounded_number_of_features(spark, tmp_path):
    points = spark.range(95).select("id", F.concat(F.lit('a"<'), F.col("id")).alias("name"), F.lit(1.5).alias("x"), F.col("id").cast("double").alias("y")).coalesce(1)
    files.write_geojson_points(points, f"file://{tmp_path}/p", most=10)
    assert len(list((tmp_path / "p").glob("part-*.txt"))) == 10
    assert sorted((r["id"], r["name"], r["y"]) for r in files.read_geojson(spark, f"file://{tmp_path}/p").collect()) == [(i, f'a"<{i}', float(i)) for i in range(95)]


def test_a_stream_comes_in_slices_of_time(spark):
    rows = spark.range(400).select((F.lit(1700000000) + F.col("id") * 3600).cast("timestamp").alias("ts"), (F.col("id") % 5).alias("k"))
    stream = events.table_stream(spark, rows.repartition(6), "slices")
    done = events.run_to_end(stream.groupBy("k").agg(F.count("*").alias("n")), "update", "slices-out")
    assert done.select("_batch").distinct().count() == 4
    assert {r["k"]: r["n"] for r in events.latest(done, ["k"]).collect()} == {k: 80 for k in range(5)}
    first = events.run_to_end(stream.groupBy(F.lit(1).alias("one")).agg(F.max("ts").alias("high"), F.min("ts").alias("low")), "update", "slices-time").orderBy("_batch").collect()
    assert [r["low"] for r in first] == [first[0]["low"]] * 4 and all(a["high"] < b["high"] for a, b in zip(first[:-1], first[1:]))
