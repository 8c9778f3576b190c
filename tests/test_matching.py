"""Greedy matching in rounds against the loop over one order; no group of pairs goes to one Python task."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import evaluation


def test_greedy_match_in_rounds(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(i), int(d), int(g)) for i, d, g in rng.integers(0, [2, 40, 15], (500, 3))})
    score = rng.integers(0, 6, (2, 40)) / 4
    rows = [(i, d, g, float(score[i, d]), float(rng.integers(1, 6)) / 8) for i, d, g in pairs]
    used, want = set(), []
    for i, d, g, s, o in sorted(rows, key=lambda r: (-r[3], r[1], -r[4], r[2])):
        if ("d", i, d) not in used and ("g", i, g) not in used:
            used |= {("d", i, d), ("g", i, g)}
            want.append((d, g, o))
    table = spark.createDataFrame(rows, "img int, d long, g long, score double, iou double")
    matched = evaluation.greedy_match(table, ["img"])
    assert sorted(tuple(r) for r in matched.collect()) == sorted(want)
    assert "InPandas" not in matched._jdf.queryExecution().toString()
    assert evaluation.greedy_match(table.limit(0), ["img"]).count() == 0


def test_lots_grow_as_truths_go(spark, monkeypatch):
    """Lots are bounded by their pairs, settled in tasks or in rounds, and give what one order gives; scores may be missing or tied."""
    rng = np.random.default_rng(4)
    boxes = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 30)), None if i % 17 == 0 else float("nan") if i % 29 == 0 else float(rng.integers(0, 40))) for i in range(400)]
    truths = [(i, i % 2, int(rng.integers(0, 30))) for i in range(60)]
    iou = lambda x, y: 1 - abs(x - y) / 8
    first = lambda s: (s is None, s is not None and s != s, 0 if s is None or s != s else -s)
    used, want = set(), []
    for s, d, o, g in sorted((first(s), d, -iou(x, y), g) for d, i, x, s in boxes for g, j, y in truths if i == j and abs(x - y) < 6):
        if ("d", d) not in used and ("g", g) not in used:
            used |= {("d", d), ("g", g)}
            want.append((d, g, -o))
    d, t = spark.createDataFrame(boxes, "id long, img int, x int, score double"), spark.createDataFrame(truths, "id long, img int, y int")
    near = F.abs(F.col("x") - F.col("y"))
    made = lambda a, b: a.alias("a").join(b.alias("b"), "img").where(near < 6).select("img", F.col("a.id").alias("d"), F.col("b.id").alias("g"), "score", (1 - near / 8).alias("iou"))
    for lot, most in ((5_000, 3_000_000), (20, 500), (200, 0)):
        monkeypatch.setattr(evaluation, "_FIRST", lot)
        monkeypatch.setattr(evaluation, "_SETTLED", most)
        sizes = []
        counted = lambda a, b: (sizes.append(a.count()), made(a, b))[1]  # noqa: B023, E731
        assert sorted(tuple(r) for r in evaluation.match_boxes(d, t, counted, ["img"]).collect()) == sorted(want)
        assert most != 500 or (len(sizes) > 2 and sizes[0] < 60)
