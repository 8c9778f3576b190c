"""Pairs of small features are told in the task of their cell."""

import random

import pytest

from geoloom.operators import ringcells, rings

LAYER = "key long, ring array<struct<x:double,y:double>>"


def closed(path):
    return [{"x": float(x), "y": float(y)} for x, y in [*path, path[0]]]


@pytest.mark.parametrize("sizes", [(16384, 1 << 18, 8192), (3, 7, 5)])
def test_pairs_told_by_sides_are_those_told_by_edges(spark, monkeypatch, sizes):
    """Convex rings of all sorts of contact, some with a hole, some copies, some with bays and one very large, in large and small parts."""
    for name, value in zip(("_PART", "_TOGETHER", "_PAIRS"), sizes, strict=True):
        monkeypatch.setattr(ringcells, name, value)
    rng = random.Random(5)
    made = []
    for i in range(60):
        x, y, w, h = rng.randint(0, 14), rng.randint(0, 14), rng.choice([2, 4, 6]), rng.choice([2, 4, 6])
        shape = [[(0, 0), (w, 0), (0, h)], [(0, 0), (w, 0), (w, h), (0, h)], [(0, 0), (w, 0), (1, 1), (0, h)], [(1, 0), (w, 1), (w, 2), (1, h), (0, 1)]][i % 4]
        paths = [[(x + a, y + b) for a, b in shape]]
        if i % 8 == 1 and min(w, h) > 2:
            paths.append([(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1)])
        made.append((i, [closed(p) for p in paths]))
    made.append((60, [closed([(-90, -90), (90, -90), (90, 90), (-90, 90)])]))
    layer = spark.createDataFrame(made, "key long, rings array<array<struct<x:double,y:double>>>")
    flags = ["l", "r", "contact", "l_in", "l_out", "r_in", "r_out", "same"]
    found = {}
    for match in (None, "contains", "within", "intersects"):
        cells = sorted(map(tuple, rings.relate(layer, layer, 4, match=match).select(*flags).collect()))
        assert cells == sorted(cells) and len(set(cells)) == len(cells)
        found[match] = cells
    monkeypatch.setattr(rings, "_FEW", 0)
    for match, cells in found.items():
        assert cells == sorted(map(tuple, rings.relate(layer, layer, 4, match=match).select(*flags).collect())) and len(cells) >= 60
        keys = [c[:2] for c in cells]
        monkeypatch.setattr(rings, "_FEW", 64)
        assert match is None or keys == sorted(map(tuple, rings.relate(layer, layer, 4, match=match, flags=False).collect()))
        monkeypatch.setattr(rings, "_FEW", 0)


def test_no_pair_carries_its_rings(spark):
    layer = spark.createDataFrame([(1, closed([(0, 0), (4, 0), (0, 4)]))], LAYER)
    plan = rings.relate(layer, layer, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("least", [0.0, 1.5])
def test_shared_areas_are_those_of_overlays(spark, least):
    rng = random.Random(9)
    made = []
    for i in range(80):
        x, y, w, h = rng.randint(0, 14), rng.randint(0, 14), rng.choice([2, 3, 5]), rng.choice([2, 4, 6])
        shape = [[(0, 0), (w, 0), (0, h)], [(0, h), (w, h), (w, 0), (0, 0)], [(0, 0), (w, 0), (1, 1), (0, h)], [(1, 0), (w, 1), (w, 2), (1, h), (0, 1)]][i % 4]
        made.append((i, closed([(x + a, y + b) for a, b in shape])))
    left, right = spark.createDataFrame(made, LAYER), spark.createDataFrame([m for m in made if m[0] % 4 != 2] + [(90, closed([(-50, -50), (50, -50), (0, 70)])), (91, None)], LAYER)
    shared = rings.shared_areas(left, right, ("key", "key"), 4, least)
    want = sorted(map(tuple, rings.overlay(left, right, 4, least).selectExpr("l.key", "r.key", "area").collect()))
    assert sorted(map(tuple, shared.collect())) == want and len(want) > 80
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
