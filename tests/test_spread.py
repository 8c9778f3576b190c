"""Joins of small files whose rows become many: dealt out, never broadcast, and each place looked at once."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import detections, evaluation, spatial
from geoloom.plans import metrics
from geoloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["vector_point_inspect", "buffer_join_first"])
def test_places_are_looked_at_once_and_boxes_not_broadcast(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    distances = text[text.index("SortMergeJoin") :]
    assert "BroadcastExchange" not in distances
    assert "gx" in distances.splitlines()[0]


def test_distances_from_cells_of_any_size(spark):
    rng = random.Random(5)
    boxes = [(i, x, y, x + rng.randint(0, 40), y + rng.randint(0, 40)) for i in range(80) for x, y in [(rng.randint(-60, 60), rng.randint(-60, 60))]]
    points = [(i, rng.randint(-70, 110), rng.randint(-70, 110)) for i in range(200)]
    want = sorted((b[0], p[0]) for b in boxes for p in points if max(b[1] - p[1], p[1] - b[3], 0) ** 2 + max(b[2] - p[2], p[2] - b[4], 0) ** 2 <= 25)
    l, r = spark.createDataFrame(boxes, "id long, xmin int, ymin int, xmax int, ymax int"), spark.createDataFrame(points, "id long, x int, y int")
    for size in (None, 3, 16):
        got = spatial.within_distance(l, r, 5, size).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
        assert sorted(map(tuple, got.collect())) == want


def _greedy(boxes, most):
    kept = []
    for b in sorted((b for b in boxes if b[6] is not None), key=lambda b: (-b[6], b[0])):
        if all(b[1] != k[1] or _iou(b, k) <= most for k in kept):
            kept.append(b)
    return sorted([k[0] for k in kept] + [b[0] for b in boxes if b[6] is None])


def _iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(w, 0) * max(h, 0)
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)


def _boxes(seed, n):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 1), x, y, x + rng.randint(1, 20), y + rng.randint(1, 20), rng.choice([None, *map(float, range(40))])) for i in range(n) for x, y in [(rng.randint(0, 50), rng.randint(0, 50))]]


BOXES = "id long, img int, xmin int, ymin int, xmax int, ymax int, score double"


@pytest.mark.parametrize("most", [0.0, 0.2])
def test_suppression_lot_by_lot(spark, monkeypatch, most):
    monkeypatch.setattr(detections, "_AT_ONCE", 40)
    made = _boxes(7, 300)
    sizes = []
    decided = detections._decided
    monkeypatch.setattr(detections, "_decided", lambda head, *rest: (sizes.append(head.count()), decided(head, *rest))[1])
    got = sorted(r["id"] for r in detections.suppress(spark.createDataFrame(made, BOXES), ["img"], most).collect())
    assert got == _greedy(made, most)
    assert len(sizes) > 1 and max(sizes) < 120


def test_lots_of_crowded_boxes_stay_small(spark, monkeypatch):
    """A lot's overlaps grow with its square: a share of all boxes made too many at large tables."""
    monkeypatch.setattr(detections, "_AT_ONCE", 40)
    made = [(i, 0, i % 7, i % 5, i % 7 + 9, i % 5 + 9, float(i)) for i in range(4000)]
    tables, written = [], detections.written
    monkeypatch.setattr(detections, "written", lambda df, label: (tables.append((label, written(df, label))), tables[-1][1])[1])
    got = sorted(r["id"] for r in detections.suppress(spark.createDataFrame(made, BOXES), ["img"], 0.0).collect())
    assert got == _greedy(made, 0.0)
    assert max(df.count() for label, df in tables if label == "overlaps") < 1600


@pytest.mark.parametrize("settled", [0, 10**6])
def test_lots_in_rounds_and_in_a_task(spark, monkeypatch, settled):
    monkeypatch.setattr(detections, "_AT_ONCE", 60)
    monkeypatch.setattr(detections, "_SETTLED", settled)
    made = _boxes(11, 300)
    assert sorted(r["id"] for r in detections.suppress(spark.createDataFrame(made, BOXES), ["img"], 0.1).collect()) == _greedy(made, 0.1)


def test_a_crowded_place_is_settled_in_a_task(spark, monkeypatch):
    """A lot of one place has more than a million overlaps; rounds of joins over them took most of the time."""
    made = [(i, 0, i % 7, i % 5, i % 7 + 9, i % 5 + 9, float(i % 900)) for i in range(1600)]
    labels, written = [], detections.written
    monkeypatch.setattr(detections, "written", lambda df, label: (labels.append(label), written(df, label))[1])
    got = sorted(r["id"] for r in detections.suppress(spark.createDataFrame(made, BOXES), ["img"], 0.0).collect())
    assert got == _greedy(made, 0.0)
    assert labels == ["boxes", "overlaps", "kept"]


def test_matching_lot_by_lot(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_AT_ONCE", 40)
    made, truths = _boxes(8, 250), _boxes(9, 40)
    used, want = set(), []
    for b in sorted(made, key=lambda b: (b[6] is None, -(b[6] or 0), b[0])):
        for o, g in sorted(((_iou(b, g), g[0]) for g in truths if g[1] == b[1] and g[0] not in used), key=lambda x: (-x[0], x[1]))[:1]:
            if o > 0.1:
                used.add(g)
                want.append((b[0], g))
    lots = []
    pairs = lambda d, g: (lots.append(d.count()), metrics.overlapping(d, g).where("iou > 0.1"))[1]
    got = evaluation.match_boxes(spark.createDataFrame(made, BOXES), spark.createDataFrame(truths, BOXES), pairs, ["img"])
    assert sorted((r["d"], r["g"]) for r in got.collect()) == sorted(want)
    assert len(lots) > 2 and sum(lots) == len(made)


@pytest.mark.parametrize("name", ["box_iou", "box_containment", "detection_confusion", "corloc"])
def test_images_part_the_pairs(spark, name):
    """Boxes of different images never meet, and no table of cells is broadcast."""
    joins = [line for line in plan(QUERIES[name](spark, DATA)).splitlines() if "MergeJoin" in line and "_gx" in line]
    assert joins and all("_by0" in line for line in joins)


def test_shares_of_few_truths_are_enough(spark, tmp_path, monkeypatch):
    seen = []
    pairs = spatial.box_pairs
    monkeypatch.setattr(spatial, "box_pairs", lambda l, r, *rest, **more: (seen.append((l.count(), r.count())), pairs(l, r, *rest, **more))[1])
    QUERIES["grid_semi_join"](spark, "/root/testdata/sf0.1").collect()
    assert seen[0][1] < seen[2][1] and seen[2][0] < seen[0][0] / 2


def test_places_of_points_in_boxes_are_looked_at_once(spark, monkeypatch):
    seen = []
    held = spatial.points_in_boxes
    monkeypatch.setattr(spatial, "points_in_boxes", lambda p, *rest: (seen.append(p.count()), held(p, *rest))[1])
    QUERIES["point_in_polygon_join"](spark, "/root/testdata/sf0.1").count()
    assert seen == [1000]


@pytest.mark.parametrize("name", ["overlay_intersection", "spatial_join", "clip_vector", "box_iou", "grid_semi_join"])
def test_boxes_are_dealt_out_before_they_become_rows(spark, name):
    """Between the explode of a box's cells and its file there is a shuffle, so that the rows of a small file aren't made in one task."""
    lines, seen = plan(QUERIES[name](spark, DATA)).splitlines(), 0
    for scan in (i for i, line in enumerate(lines) if "FileScan" in line and "part.parquet" in line):
        branch = next((lines[i:scan] for i in range(scan - 1, -1, -1) if "Generate explode" in lines[i] or "FileScan" in lines[i]), [])
        if branch and "Generate explode" in branch[0]:
            seen += 1
            assert any("Exchange hashpartitioning(id" in line for line in branch)
    assert seen
