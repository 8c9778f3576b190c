"""Goldens and properties of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry, text
from geoloom.operators import detections, evaluation, raster, sampling, spatial
from geoloom.plans.filters import condition
from geoloom.sources import files

L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]


def ring(points):
    return F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in points])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_l_shape(spark):
    assert one(spark, geometry.area(ring(L))) == 7
    assert one(spark, geometry.perimeter(ring(L))) == 16
    inside = lambda x, y: one(spark, geometry.contains(ring(L), F.lit(float(x)), F.lit(float(y))))
    assert inside(0.5, 3) and inside(3, 0.5) and not inside(3, 3) and not inside(5, 0.5)
    assert inside(0, 0) and not inside(4, 0.5)  # left and lower edges are in
    assert not one(spark, geometry.valid(ring([(0, 0), (1, 1), (2, 2), (0, 0)])))


def test_tiles_and_back(spark):
    x, y = geometry.tile_of(F.lit(105.8), F.lit(21.0), 10)
    a, b = one(spark, x), one(spark, y)
    key = one(spark, geometry.quadkey(F.lit(a), F.lit(b), 10))
    assert len(key) == 10
    assert (one(spark, geometry.tile_of_quadkey(F.lit(key))[0]), one(spark, geometry.tile_of_quadkey(F.lit(key))[1])) == (a, b)
    assert one(spark, geometry.quadkey(F.lit(3), F.lit(5), 3)) == "213"


def test_pairs_meet_once(spark):
    rng = np.random.default_rng(0)
    made = [(i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, 90, (60, 4)))]
    boxes = spark.createDataFrame(made, "id long, xmin int, ymin int, xmax int, ymax int")
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in spatial.box_pairs(boxes, boxes, 16).collect())
    want = sorted((a[0], b[0]) for a in made for b in made if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    assert got == want
    plan = spatial.box_pairs(boxes, boxes, 16)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_suppression(spark):
    rng = np.random.default_rng(1)
    made = [(i, 0, int(x), int(y), int(x) + 10, int(y) + 10, float(s)) for i, (x, y, s) in enumerate(rng.integers(0, 40, (80, 3)))]
    boxes = spark.createDataFrame(made, "id long, img int, xmin int, ymin int, xmax int, ymax int, score double")
    kept = []

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return max(w, 0) * max(h, 0) / (200 - max(w, 0) * max(h, 0))

    for box in sorted(made, key=lambda b: (-b[6], b[0])):
        if all(iou(box, k) <= 0.2 for k in kept):
            kept.append(box)
    assert sorted(r["id"] for r in detections.suppress(boxes, ["img"], 0.2).collect()) == sorted(k[0] for k in kept)


def test_regions_cross_tiles(spark):
    snake = [(r, c, 1) for r in range(0, 12, 2) for c in range(12)] + [(r, 11 if r % 4 == 1 else 0, 1) for r in range(1, 11, 2)]
    found = detections.regions(spark.createDataFrame(snake, "r int, c int, cls int"), tile=4)
    assert {r["region"] for r in found.collect()} == {0} and found.count() == len(snake)


def test_morphology_orders(spark):
    mask = spark.createDataFrame([(r, c, (r * 7 + c * 3) % 5) for r in range(8) for c in range(8)], "r int, c int, cls int")
    k = raster.kernel(3)
    at = lambda d: {(r["r"], r["c"]): r["cls"] for r in d.collect()}
    low, mid, high = at(raster.erode(mask, k)), at(mask), at(raster.dilate(mask, k))
    assert all(low[p] <= mid[p] <= high[p] for p in mid)
    assert at(raster.opening(raster.opening(mask, k), k)) == at(raster.opening(mask, k))


def test_global_ap_golden(spark):
    rows = spark.createDataFrame([("a", 0.9, 0), ("b", 0.8, 1), ("c", 0.7, 0), ("d", 0.1, 0)], "k string, score double, correct int")
    assert evaluation.global_average_precision(rows, ["score", "k"], [False, True]).first()["gap"] == pytest.approx(0.5)


def test_split_is_exact_and_stable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"]: r["part"] for r in sampling.split(rows, "k", {"train": 0.7, "val": 0.2, "test": 0.1}).collect()}
    b = {r["k"]: r["part"] for r in sampling.split(rows.repartition(7), "k", {"train": 0.7, "val": 0.2, "test": 0.1}).collect()}
    assert a == b and [list(a.values()).count(p) for p in ("train", "val", "test")] == [700, 200, 100]


def test_conditions(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")
    spec = [{"column": "a", "operator": ">=", "value": 2}, {"column": "b", "operator": "in", "value": ["x", "y"]}]
    got = lambda mode: sorted(r["a"] for r in rows.where(condition(spec, mode)).collect())
    assert got("all") == [2] and got("any") == [1, 2, 3] and got("none") == []


def test_bad_layers_are_refused(spark):
    layer = spark.createDataFrame([(1, "Point", 0.0), (2, "Polygon", 1.0)], "id int, kind string, x double")
    with pytest.raises(ValueError, match="mixes"):
        files.validated(layer, F.lit(True), "kind", ["x"])
    with pytest.raises(ValueError, match="no valid"):
        files.validated(layer, F.lit(False), "kind", ["x"])
    with pytest.raises(ValueError, match="infinite"):
        files.validated(layer.withColumn("x", F.lit(1e200)), F.col("id") == 1, "kind", ["x"])


def test_ngrams(spark):
    words = text.tokens(F.lit("The cat_1, the DOG!"))
    assert one(spark, words) == ["the", "cat_1", "the", "dog"]
    assert one(spark, text.ngrams(words, 3)) == ["the cat_1 the", "cat_1 the dog"]
    assert one(spark, text.ngrams(text.tokens(F.lit("a")), 2)) == []
