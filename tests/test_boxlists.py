"""Lists of what overlaps a box come from one task a cell, never from a row for each pair."""

import random

import pytest

from geoloom.operators import boxlists
from geoloom.plans.base import Tables
from geoloom.plans.joins import spatial_join_one_to_one
from geoloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SIDES = "xmin int, ymin int, xmax int, ymax int"


def _boxes(seed, n, most, ids=None):
    rng = random.Random(seed)
    return [(ids[i] if ids else i, x, y, x + rng.randint(0, most), y + rng.randint(0, most)) for i in range(n) for x, y in [(rng.randint(-60, 60), rng.randint(-60, 60))]]


def _meets(a, b):
    return a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]


@pytest.mark.parametrize(("size", "part", "together"), [(4, 2048, 1 << 18), (64, 3, 7)])
def test_lists_equal_those_of_all_pairs(spark, monkeypatch, size, part, together):
    monkeypatch.setattr(boxlists, "_PART", part)
    monkeypatch.setattr(boxlists, "_TOGETHER", together)
    left = [*_boxes(1, 120, 30), (900, -200, -200, 300, 300), (901, 5, 5, 5, 5), (902, None, 0, 9, 9)]
    right = [*_boxes(2, 90, 25, [*range(5), None, *range(6, 90)]), (10, 0, 0, 40, 40), (950, -400, -400, 400, 400), (951, 0, None, 9, 9)]
    want = {}
    for l in left:
        if met := [r for r in right if None not in l[1:] + r[1:] and _meets(l, r)]:
            ids, x = sorted(r[0] for r in met if r[0] is not None), [r[1] for r in met]
            mean = sum(x) / len(x)
            want[l[0]] = (len(met), ",".join(map(str, ids)) if ids else None, min(x), max(x), sum(x), round(sum((v - mean) ** 2 for v in x), 3), ids[0] if ids else None, ids[-1] if ids else None)
    got = boxlists.merged_boxes(spark.createDataFrame(left, f"id long, {SIDES}"), spark.createDataFrame(right, f"id long, {SIDES}"), ["xmin"], size).collect()
    assert {r[0]: (*r[1:6], round(r[6], 3), *r[7:]) for r in got} == want
    assert len(got) == len(want)


def test_no_boxes(spark):
    none, some = spark.createDataFrame([], f"id long, {SIDES}"), spark.createDataFrame(_boxes(3, 5, 9), f"id long, {SIDES}")
    assert boxlists.merged_boxes(none, some, ["xmin"], 8).isEmpty()
    assert boxlists.merged_boxes(some, none, ["xmin"], 8).isEmpty()


def test_one_to_one_makes_no_row_for_each_pair(spark):
    text = QUERIES["spatial_join_one_to_one"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    alone = text[text.index("MapInArrow found") : text.index("ObjectHashAggregate") if "ObjectHashAggregate" in text else None]
    assert "collect_list" not in alone and "own" in alone


def test_boxes_that_share_an_id_are_one_group(spark):
    class Given(Tables):
        boxes = spark.createDataFrame([(1, 0, 0, 9, 9), (1, 20, 20, 29, 29), (2, 0, 0, 9, 9)], f"id long, {SIDES}")
        truths = spark.createDataFrame([(7, 1, 1, 5, 5), (8, 21, 21, 25, 25)], f"id long, {SIDES}")

    got = {r["id"]: (r["n"], r["first"], r["last"], r["joined"], r["total"], r["deviation"]) for r in spatial_join_one_to_one(Given(spark, "")).collect()}
    assert got == {1: (2, 7, 8, "7,8", 22, 14.142136), 2: (1, 7, 7, "7", 1, None)}
