"""Regions and learned operators against plain versions."""

import json

import numpy as np
import pytest

from geoloom.operators import detections, learned


def flooded(cells: dict) -> dict:
    name = {}
    for start in sorted(cells):
        stack = [start]
        while stack:
            at = stack.pop()
            if at in name:
                continue
            name[at] = start
            stack += [n for n in ((at[0] + 1, at[1]), (at[0] - 1, at[1]), (at[0], at[1] + 1), (at[0], at[1] - 1)) if cells.get(n) == cells[at]]
    return name


@pytest.mark.parametrize("seed", [0, 1])
def test_regions_by_flooding(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {(r - 9, c): int(rng.random() < 0.55) for r in range(30) for c in range(30) if rng.random() < 0.9}
    mask = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r int, c int, cls int")
    got = {(r["r"], r["c"]): (r["region"] >> 32, r["region"] & 0xFFFFFFFF) for r in detections.regions(mask, tile=8).collect()}
    want = flooded(cells)
    # A region is named by a cell of its own, one name each.
    assert set(got) == set(want) and len({(got[p], want[p]) for p in got}) == len(set(want.values())) == len(set(got.values()))
    if seed:
        return
    runs = learned.region_table(detections.regions(mask), "cls", {0: "no", 1: "yes"}).collect()
    assert sorted(r["cells"] for r in runs) == sorted(np.unique([str(x) for x in want.values()], return_counts=True)[1].tolist())
    covered = [(x["r"], x["c"] + i, r["class"]) for r in runs for x in json.loads(r["runs"]) for i in range(x["n"])]
    assert sorted(covered) == sorted((r, c, ("no", "yes")[v]) for (r, c), v in cells.items())


def test_regions_of_no_cells(spark):
    assert detections.regions(spark.createDataFrame([], "r int, c int, cls int")).count() == 0


def test_codebook_is_a_fixed_point(spark):
    """Well-parted groups get a word each, and every vector has the word of its nearest mean."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.2, (50, 3)) for m in (0, 4, 8)])
    got = learned.codebook(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>"), "id", "v", 3).orderBy("id").collect()
    word = np.array([r["word"] for r in got])
    means = np.array([x[word == k].mean(axis=0) for k in range(3)])
    assert (((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == word).all()
    assert ((x - means[word]) ** 2).sum() == pytest.approx(sum(((g - g.mean(axis=0)) ** 2).sum() for g in np.split(x, 3)))


def test_anchors_are_the_typical_sizes(spark):
    rng = np.random.default_rng(2)
    sizes = [(w + rng.uniform(-0.5, 0.5), h + rng.uniform(-0.5, 0.5)) for w, h in ((10, 20), (40, 15), (60, 90)) for _ in range(40)] + [(1.0, 50.0)]
    boxes = spark.createDataFrame([(0.0, 0.0, float(w), float(h)) for w, h in sizes], "xmin double, ymin double, xmax double, ymax double")
    got = [(r["w"], r["h"]) for r in learned.anchors(boxes, 3).collect()]
    want = sorted((tuple(np.mean(sizes[i * 40 : i * 40 + 40], axis=0)) for i in range(3)), key=lambda p: p[0] * p[1])
    assert np.allclose(got, want, atol=1e-3)


def test_classifier_learns_a_rule(spark):
    rng = np.random.default_rng(5)
    rows = [("s", i, 0, float(a), float(b), int(a > b)) for i, (a, b) in enumerate(rng.random((800, 2)))]
    got = learned.classified(spark.createDataFrame(rows, "scene_id string, r int, c int, b1 double, b2 double, label int"), ["b1", "b2"], "label").first()
    assert got["f1"] > 0.85 and 100 < got["n"] < 220 and got["jaccard"] == pytest.approx(got["f1"] / (2 - got["f1"]), abs=1e-3)


def test_scores_of_the_classifier_by_counting(spark):
    rng = np.random.default_rng(6)
    rows = [("s", i, i % 7, float(a), float(b), int(a + 0.3 * rng.normal() > b)) for i, (a, b) in enumerate(rng.random((700, 2)))]
    cells = spark.createDataFrame(rows, "scene_id string, r int, c int, b1 double, b2 double, label int")
    held = learned.predicted(cells, ["b1", "b2"], "label").collect()
    hit = sum(r["prediction"] == 1 and r["label"] == 1 for r in held)
    said, true = sum(r["prediction"] == 1 for r in held), sum(r["label"] == 1 for r in held)
    got = learned.classified(cells, ["b1", "b2"], "label").first()
    assert got["n"] == len(held) and 0 < hit < said
    assert got["f1"] == pytest.approx(2 * hit / (said + true), abs=1e-4) and got["jaccard"] == pytest.approx(hit / (said + true - hit), abs=1e-4)


def test_tall_cells_by_all_ways_to_cluster(spark):
    """Three clusters of least squares, by trying all cuts; low values count as none."""
    from itertools import combinations

    rng = np.random.default_rng(7)
    rows = [(s, i, round(float(v), 2)) for s in ("a", "b") for i, v in enumerate(np.concatenate([rng.uniform(0, 4, 20), rng.normal(9, 1, 15), rng.normal(30, 2, 5)]))] + [("c", 0, 2.0), ("c", 1, 1.0)]
    got = {(r["s"], r["i"]): r["tall"] for r in learned.tall(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], "v", 3, 3.0).collect()}
    for s in ("a", "b", "c"):
        own = [(i, v if v > 3 else 0.0) for x, i, v in rows if x == s]
        kinds = sorted({v for _, v in own})
        best = None
        for cuts in combinations(range(1, len(kinds)), min(2, len(kinds) - 1)):
            parts = [kinds[a:b] for a, b in zip((0, *cuts), (*cuts, len(kinds)), strict=True)]
            groups = [[v for _, v in own if v in p] for p in parts]
            cost = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
            if best is None or cost < best[0] - 1e-9:
                best = cost, {v: np.mean(g) for p, g in zip(parts, groups, strict=True) for v in p}
        for i, v in own:
            assert got[s, i] == (255 if best[1][v] > 3 else 0), (s, i)
