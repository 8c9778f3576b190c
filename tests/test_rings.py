"""Ring relations, clipping, filling and outlines against plain versions on lattices."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import outlines, rings, spatial

LAYER = "id long, ring array<struct<x:double,y:double>>"


def bars(heights, low=None):
    """The ring and cells of a polygon of upright bars side by side."""
    low = low or [0] * len(heights)
    top = [p for i, h in enumerate(heights) for p in ((i, h), (i + 1, h))]
    bottom = [p for i, h in enumerate(low) for p in ((i, h), (i + 1, h))]
    path = bottom + top[::-1]
    ring = [p for i, p in enumerate(path) if p != path[i - 1]]
    return ring, {(i, y) for i, (a, b) in enumerate(zip(low, heights, strict=True)) for y in range(a, b)}


def shapes(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        heights = [rng.randint(1, 4) for _ in range(rng.randint(1, 4))]
        ring, cells = bars(heights)
        dx, dy = rng.randint(0, 5), rng.randint(0, 5)
        turned = rng.random() < 0.5
        move = (lambda x, y: (y + dx, x + dy)) if turned else (lambda x, y: (x + dx, y + dy))  # noqa: B023
        out.append((i, [move(*p) for p in ring], {move(*c) for c in cells}))
    return out


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


#: An integer shear keeps all relations and makes edges slant.
SHEARS = [lambda x, y: (x, y), lambda x, y: (3 * x + y, 2 * x + 5 * y)]


def corners(cells):
    return {(x + i, y + j) for x, y in cells for i in (0, 1) for j in (0, 1)}


@pytest.mark.parametrize("shear", SHEARS)
def test_relations_of_rings(spark, shear):
    a, b = shapes(1, 30), shapes(2, 30)
    b += [(100 + i, ring, cells) for i, ring, cells in a[:6]]  # equal ones
    rng = random.Random(3)
    layer = lambda s: spark.createDataFrame([(i, closed([shear(*p) for p in (ring if rng.random() < 0.5 else ring[::-1])])) for i, ring, _ in s], LAYER)
    left, right = layer(a).withColumnRenamed("id", "key"), layer(b).withColumnRenamed("id", "key")
    names = ["intersects", "touches", "contains", "within", "overlaps", "equals", "crosses"]
    got = {(r["l"], r["r"]): tuple(r[n] for n in names) for r in rings.relate(left, right, 4).select("l", "r", *[rings.matches(n).alias(n) for n in names]).collect()}
    seen = defaultdict(int)
    for i, _, x in a:
        for j, _, y in b:
            inner, shared = bool(x & y), bool(corners(x) & corners(y))
            want = (shared, shared and not inner, y <= x, x <= y, inner and not (x <= y or y <= x), x == y, False)
            assert got.get((i, j), (False,) * 7) == want, (i, j)
            seen[want] += 1
    assert len(seen) >= 6


def with_holes(seed, n):
    """Rectangles with up to two holes: their rings and cells."""
    rng, out = random.Random(seed), []
    for i in range(n):
        wide, high, dx, dy = rng.randint(5, 7), rng.randint(3, 6), rng.randint(0, 4), rng.randint(0, 4)
        paths, cells = [[(0, 0), (wide, 0), (wide, high), (0, high)]], {(x, y) for x in range(wide) for y in range(high)}
        for x0, x1 in ((1, 2), (3, wide - 1))[: rng.randint(0, 2)]:
            y0 = rng.randint(1, high - 2)
            y1 = rng.randint(y0 + 1, high - 1)
            path = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
            paths.append(path if rng.random() < 0.5 else path[::-1])
            cells -= {(x, y) for x in range(x0, x1) for y in range(y0, y1)}
        out.append((i, [[(x + dx, y + dy) for x, y in p] for p in paths], {(x + dx, y + dy) for x, y in cells}))
    return out


@pytest.mark.parametrize("shear", SHEARS)
def test_relations_of_rings_with_holes(spark, shear):
    a, b = with_holes(11, 30), with_holes(12, 30)
    # What fills a hole, lies in one or is the same.
    plugs = [[hole] for _, paths, _ in b for hole in paths[1:]]
    area = lambda p: {(x, y) for x in range(min(q[0] for q in p), max(q[0] for q in p)) for y in range(min(q[1] for q in p), max(q[1] for q in p))}
    a += [(100 + i, paths, area(paths[0])) for i, paths in enumerate(plugs)] + [(200 + i, paths, cells) for i, paths, cells in b[:5]]
    a += [(300 + i, [ring], cells) for i, ring, cells in shapes(13, 20)]
    big = {(x, y) for x in range(-5, 20) for y in range(-5, 20)} - {(x, y) for x in range(-2, 15) for y in range(-2, 15)}
    b.append((99, [[(-5, -5), (20, -5), (20, 20), (-5, 20)], [(-2, -2), (15, -2), (15, 15), (-2, 15)]], big))
    layer = lambda s: spark.createDataFrame([(i, [closed([shear(*p) for p in ring]) for ring in paths]) for i, paths, _ in s], "key long, rings array<array<struct<x:double,y:double>>>")
    names = ["intersects", "touches", "contains", "within", "overlaps", "equals"]
    seen = defaultdict(int)
    for first, second in ((a, b), (b, a)):
        got = {(r["l"], r["r"]): tuple(r[n] for n in names) for r in rings.relate(layer(first), layer(second), 4).select("l", "r", *[rings.matches(n).alias(n) for n in names]).collect()}
        for i, _, x in first:
            for j, _, y in second:
                inner, shared = bool(x & y), bool(corners(x) & corners(y))
                want = (shared, shared and not inner, y <= x, x <= y, inner and not (x <= y or y <= x), x == y)
                assert got.get((i, j), (False,) * 6) == want, (i, j)
                seen[want] += 1
    assert len(seen) >= 6


def test_odd_rings_with_holes(spark):
    """No shell, no rings and a shell of no area take no part; a hole of no area is none, and a null one neither."""
    box = closed([(0, 0), (9, 0), (9, 9), (0, 9)])
    layer = "key long, rings array<array<struct<x:double,y:double>>>"
    left = spark.createDataFrame([(1, [box, closed([(1, 1), (2, 2), (3, 3)]), None]), (2, None), (3, []), (4, [None, box]), (5, [closed([(1, 1), (2, 2), (3, 3)])])], layer)
    right = spark.createDataFrame([(7, closed([(2, 2), (4, 2), (4, 4)]))], "key long, ring array<struct<x:double,y:double>>")
    assert [(r["l"], r["r"]) for r in rings.relate(left, right, 4).where(rings.matches("contains")).collect()] == [(1, 7)]
    assert rings.relate(left.limit(0), right, 4).isEmpty()
    joined = rings.join(right, left, ("key", "key"), "within", size=4).collect()
    assert [(r["l"]["key"], r["r"]["key"]) for r in joined] == [(7, 1)]


@pytest.mark.parametrize("shear", SHEARS)
def test_relations_of_lines(spark, shear):
    b, rng, lines = shapes(4, 20), random.Random(5), []
    for i in range(40):
        at = (rng.randint(0, 8), rng.randint(0, 8))
        path = [at]
        for _ in range(rng.randint(1, 5)):
            step = rng.choice([(1, 0), (0, 1)] if i % 2 else [(1, 0), (0, -1)])
            path.append((path[-1][0] + step[0], path[-1][1] + step[1]))
        lines.append((i, path))
    left = spark.createDataFrame([(i, [tuple(map(float, shear(*p))) for p in path]) for i, path in lines], LAYER).withColumnRenamed("id", "key")
    right = spark.createDataFrame([(i, closed([shear(*p) for p in ring])) for i, ring, _ in b], LAYER).withColumnRenamed("id", "key")
    names = ["intersects", "touches", "within", "crosses", "contains", "overlaps"]
    got = {(r["l"], r["r"]): tuple(r[n] for n in names) for r in rings.relate(left, right, 4, lines=True).select("l", "r", *[rings.matches(n, lines=True).alias(n) for n in names]).collect()}
    for i, path in lines:
        for j, _, cells in b:
            inside = outside = False
            for (x1, y1), (x2, y2) in zip(path[:-1], path[1:], strict=True):
                x, y = min(x1, x2), min(y1, y2)
                sides = [(x, y), (x, y - 1)] if y1 == y2 else [(x, y), (x - 1, y)]
                held = sum(s in cells for s in sides)
                inside |= held == 2
                outside |= held == 0
            shared = bool(set(path) & corners(cells))
            assert got.get((i, j), (False,) * 6) == (shared, shared and not inside, inside and not outside, inside and outside, False, False), (i, j)


def test_join_types(spark):
    a, b = shapes(6, 12), shapes(7, 12)
    left = spark.createDataFrame([(i, closed(r)) for i, r, _ in a] + [(50, closed([(90, 90), (91, 90), (91, 91)])), (51, None), (52, closed([(0, 0), (4, 4), (8, 8)]))], LAYER)
    right = spark.createDataFrame([(i, closed(r)) for i, r, _ in b], LAYER).withColumnRenamed("id", "zone").withColumn("name", F.lit("z"))
    want = {(i, j) for i, _, x in a for j, _, y in b if y <= x}
    assert {(r["l"]["id"], r["r"]["zone"]) for r in rings.join(left, right, ("id", "zone"), "contains", size=4).collect()} == want and want
    found = rings.join(left, right, ("id", "zone"), "contains", how="left", size=4).collect()
    alone = {i for i in [*range(12), 50, 51, 52]} - {i for i, _ in want}
    assert {(r["l"]["id"], r["r"] and r["r"]["zone"]) for r in found} == want | {(i, None) for i in alone}
    with pytest.raises(ValueError):
        rings.join(left, right, ("id", "zone"), how="full")
    assert rings.join(left.limit(0), right, ("id", "zone")).isEmpty()


def test_long_edges_go_to_the_cells_along_them(spark):
    e = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0), (5.0, 900.0, 5.0, 3.0), (7.0, 7.0, 7.0, 7.0), (16.0, 0.0, 16.0, 32.0)], "x1 double, y1 double, x2 double, y2 double")
    got = rings.along_cells(e, 16.0).collect()
    assert sum(r["x2"] == 1000 for r in got) < 4 * 64
    assert {(r["gx"], r["gy"]) for r in got if r["x1"] == 16} == {(x, y) for x in (0, 1) for y in (-1, 0, 1, 2)}


def convex(rng, n):
    points = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)})

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) / 2


def shared_area(p, q):
    """By the corners of either in the other and the crossings of edges, put in order around their middle."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = lambda s: list(zip(s, [*s[1:], s[0]], strict=True))
    points = [c for c in p if all(side(a, b, c) >= 0 for a, b in edges(q))] + [c for c in q if all(side(a, b, c) >= 0 for a, b in edges(p))]
    for a, b in edges(p):
        for c, d in edges(q):
            u, v = side(c, d, a), side(c, d, b)
            if u * v < 0 and side(a, b, c) * side(a, b, d) < 0:
                t = u / (u - v)
                points.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    if len(points) < 3:
        return 0.0
    mx, my = np.mean(points, axis=0)
    return abs(shoelace(sorted(points, key=lambda c: math.atan2(c[1] - my, c[0] - mx))))


def test_convex_clip(spark):
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 300:
        p, q = convex(rng, rng.randint(3, 12)), convex(rng, rng.randint(3, 12))
        if len(p) > 2 and len(q) > 2:
            pairs.append((len(pairs), closed(p if rng.random() < 0.5 else p[::-1]), closed(q if rng.random() < 0.5 else q[::-1]), shared_area(p, q)))
    rows = spark.createDataFrame(pairs, "id long, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>, want double")
    got = rows.select("want", F.coalesce(g.area(rings.clip_convex(F.col("p"), F.col("q"))), F.lit(0.0)).alias("got")).collect()
    assert all(abs(r["got"] - r["want"]) < 1e-7 for r in got) and sum(r["got"] > 0 for r in got) > 100


def test_convex_clip_of_rings_with_holes(spark):
    """The part in a box has as many cells as shell and holes share with it, and the clipped rings fill them."""
    features, rng = with_holes(21, 20), random.Random(22)
    masks = [(i, (x := rng.randint(-1, 6)), (y := rng.randint(-1, 6)), x + rng.randint(1, 5), y + rng.randint(1, 5)) for i in range(12)]
    left = spark.createDataFrame([(i, [closed(p) for p in paths]) for i, paths, _ in features], "id long, rings array<array<struct<x:double,y:double>>>")
    right = spark.createDataFrame([(i, closed([(a, b), (c, b), (c, d), (a, d)])) for i, a, b, c, d in masks], LAYER)
    over = rings.overlay(left, right, 4).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"), "rings", "area")
    want = {}
    for i, _, cells in features:
        for j, a, b, c, d in masks:
            if part := {(x, y) for x, y in cells if a <= x < c and b <= y < d}:
                want[i, j] = part
    got = {(r["l"], r["r"]): r for r in over.collect()}
    assert set(got) == set(want) and any(len(r["rings"]) > 1 for r in got.values())
    assert all(r["area"] == pytest.approx(len(want[k])) for k, r in got.items())
    fills = defaultdict(set)
    for r in rings.runs(over.select("l", "r", F.explode("rings").alias("ring")).withColumnRenamed("r", "m"), ["l", "m"]).collect():
        fills[r["l"], r["m"]] |= {(c, r["r"]) for c in range(r["c0"], r["c1"] + 1)}
    assert fills == want
    assert rings.clip(left, right, 4).count() == len(want) and rings.clip(left, right, 4).columns == left.columns


def test_clip_of_a_ring_with_bays(spark):
    ring, cells = bars([4, 1, 3, 1, 5])
    mask = [(0, 2), (5, 2), (5, 6), (0, 6)]
    row = spark.createDataFrame([(closed(ring), closed(mask))], "p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    assert row.select(g.area(rings.clip_convex(F.col("p"), F.col("q")))).first()[0] == sum(y >= 2 for _, y in cells)


@pytest.mark.parametrize("lines", [False, True])
def test_pairs_told_in_batches_and_by_edges_agree(spark, monkeypatch, lines):
    """Small features are told pair by pair, without a join of their edges; large ones, alone or among small ones, give the same flags by their edges."""
    features = spark.createDataFrame([(i, [closed(p) for p in paths]) for i, paths, _ in with_holes(31, 20)], "key long, rings array<array<struct<x:double,y:double>>>")
    left = features.select("key", F.get("rings", F.lit(0)).alias("ring")) if lines else features
    found, calls = [], []
    by_edges = rings._by_edges
    monkeypatch.setattr(rings, "_by_edges", lambda *rest: (calls.append(1), by_edges(*rest))[1])
    for few in (0, 10, 64):
        monkeypatch.setattr(rings, "_FEW", few)
        calls.clear()
        found.append(sorted(map(tuple, rings.relate(left, features, 4, lines).select("l", "r", "contact", "l_in", "l_out", "r_in", "r_out", "same").collect())))
        assert bool(calls) == (few < 64)
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_overlays_are_clipped_by_the_batch(spark):
    """A pair costs no folds of expressions: the clip runs over batches of pairs, masks are turned once a mask."""
    layer = spark.createDataFrame([(1, closed([(0, 0), (4, 0), (0, 4)]))], LAYER)
    over = rings.overlay(layer, layer, 4)
    lines = over._jdf.queryExecution().executedPlan().toString().splitlines()
    clips, joins = ([i for i, line in enumerate(lines) if word in line] for word in ("ArrowEvalPython", "SortMergeJoin"))
    assert clips and joins and min(clips) < min(joins)
    assert not any("reverse" in line for line in lines[: min(joins)])


def test_clip_of_a_batch_with_parts_that_vanish(spark):
    """Rings that leave nothing, masks of other numbers of sides and sides of no length stand between others of a batch."""
    square, far = closed([(0, 0), (4, 0), (4, 4), (0, 4)]), closed([(9, 9), (10, 9), (10, 10)])
    doubled, corner = closed([(1, 1), (1, 1), (3, 1), (3, 1), (3, 3)]), closed([(2, 2), (6, 2), (6, 6), (2, 6)])
    made = [(square, far, None), (square, doubled, 2.0), (far, square, None), (square, corner, 4.0), (corner, square, 4.0), (far, corner, None), (far, far, 0.5)]
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "id int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>, want double").coalesce(1)
    got = rows.select("want", g.area(rings.clip_convex(F.col("p"), F.col("q"))).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_empty_clips_are_errors(spark):
    square = spark.createDataFrame([(1, closed([(0, 0), (4, 0), (4, 4), (0, 4)]))], LAYER)
    beside = spark.createDataFrame([(2, closed([(4, 0), (8, 0), (8, 4), (4, 4)]))], LAYER)
    with pytest.raises(ValueError):
        rings.clip(square, beside)
    with pytest.raises(ValueError):
        rings.clip(square.limit(0), beside)
    half = rings.clip(square, spark.createDataFrame([(3, closed([(2, 0), (8, 0), (8, 4), (2, 4)]))], LAYER)).select("id", g.area(F.col("ring")).alias("a"))
    assert [tuple(r) for r in half.collect()] == [(1, 8.0)]


def inside(path, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(path[:-1], path[1:], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_filled_rings(spark):
    bent = closed([(0, 0), (6, 0), (6, 2), (2, 2), (2, 7), (0, 7)])
    outer, hole = closed([(10, 0), (20, 0), (20, 10), (10, 10)]), closed([(12.5, 2), (17, 4.5), (15, 8)])
    left, right = closed([(30, 0), (34.5, 1), (33, 9), (30, 9)]), closed([(34.5, 1), (40, 0), (40, 9), (33, 9)])
    rows = [(1, bent), (2, outer), (2, hole), (3, left), (4, right), (5, closed([(50.6, 0.6), (50.9, 0.6), (50.7, 0.9)]))]
    layer = spark.createDataFrame(rows, LAYER)
    got = {(r["id"], x, r["r"]) for r in rings.runs(layer, ["id"]).collect() for x in range(r["c0"], r["c1"] + 1)}
    want = {(i, x, y) for i in range(1, 6) for x in range(60) for y in range(12) if sum(inside(p, x + 0.5, y + 0.5) for j, p in rows if j == i) % 2}
    assert got == want
    assert len({c[1:] for c in got if c[0] in (3, 4)}) == sum(c[0] in (3, 4) for c in got)  # a shared border gives its cells to one side


def test_rasterized_values(spark):
    rows = [(1, closed([(0, 0), (4, 0), (4, 4), (0, 4)]), "roof"), (2, closed([(2, 2), (6, 2), (6, 6), (2, 6)]), "road"), (3, closed([(5, 5), (7, 5), (7, 7), (5, 7)]), "other")]
    layer = spark.createDataFrame(rows, LAYER + ", kind string")
    cells = lambda **k: {(r["r"], r["c"]): r["value"] for r in rings.rasterized(layer, "id", "kind", F.col("id"), **k).collect()}
    got = cells(names=["road", "roof"])
    assert got[0, 0] == 2 and got[3, 3] == 1 and got[5, 5] == 0 and len(got) == 16 + 16 - 4 + 4 - 1
    assert set(cells(names=["road", "roof"], single=255).values()) == {0, 255}
    with pytest.raises(ValueError):
        cells(names=["road", "tree"])


def flood(cells):
    """region (least cell) of every cell, by sides."""
    name = {}
    for start in sorted(cells):
        if start in name:
            continue
        todo = [start]
        name[start] = start
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells and n not in name and cells[n] == cells[r, c]:
                    name[n] = start
                    todo.append(n)
    return name


@pytest.mark.parametrize("seed", [1, 2])
def test_outlines_give_the_cells_back(spark, seed):
    rng = random.Random(seed)
    cells = {(r - 4, c - 4): rng.choice([1, 1, 1, 2, 0]) for r in range(22) for c in range(22)}
    cells = {k: v for k, v in cells.items() if v}
    cells |= {(30 + r, c): 1 for r in range(9) for c in range(9) if (r, c) not in ((4, 4), (3, 3), (2, 6))}  # two holes that meet by a corner are one
    name = flood(cells)
    number = {k: i for i, k in enumerate(sorted(set(name.values())))}
    table = spark.createDataFrame([(r, c, number[name[r, c]]) for r, c in cells], "r int, c int, region long")
    found = outlines.rings(table).collect()
    of = defaultdict(set)
    for k, v in name.items():
        of[number[v]].add(k)
    area, odd = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in found:
        path = [(p["x"], p["y"]) for p in r["outline"]]
        assert r["corners"] == len(path) - 1 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(path[:-1], path[1:], strict=True))
        area[r["region"]] += r["area"]
        for y in range(-4, 40):
            for x in range(-4, 40):
                odd[r["region"]][y, x] += inside(path, x + 0.5, y + 0.5)
    for region, own in of.items():
        assert area[region] == len(own) and {k for k, n in odd[region].items() if n % 2} == own
    assert sum(not r["hole"] for r in found) == len(of) and any(r["hole"] for r in found)
    whole = outlines.with_holes(table).collect()
    assert len(whole) == len(of) and all(w["cells"] == len(of[w["region"]]) and len(w["holes"]) == sum(r["hole"] for r in found if r["region"] == w["region"]) for w in whole)


def test_a_long_ring(spark):
    """A spiral of one cell's width: its only ring passes every cell twice."""
    n, r, c, dr, dc, cells = 41, 0, 0, 0, 1, set()
    for length in [n, *[k for k in range(n - 1, 0, -2) for _ in (0, 1)]]:
        for _ in range(length - (1 if cells else 0) if not cells else length):
            cells.add((r, c))
            r, c = r + dr, c + dc
        r, c = r - dr, c - dc
        dr, dc = dc, -dr
        r, c = r + dr, c + dc
    rows = spark.createDataFrame([(a, b, 1) for a, b in cells], "r int, c int, region long")
    found = outlines.rings(rows).collect()
    assert sum(x["area"] for x in found) == len(cells)


def test_boxes_of_very_different_sizes(spark):
    rng = random.Random(9)
    made = []
    for i in range(120):
        side = 2.0 ** rng.randint(-2, 14)
        x, y = rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)
        made.append((i, x, y, x + side, y + side * rng.random()))
    made += [(500, 0.0, 0.0, 64.0, 64.0), (501, 64.0, 64.0, 128.0, 128.0), (502, 64.0, 0.0, 64.0, 0.0)]
    layer = spark.createDataFrame(made, "id long, xmin double, ymin double, xmax double, ymax double")
    for touching in (False, True):
        less = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
        want = sorted((a[0], b[0]) for a in made[::2] for b in made if less(a[1], b[3]) and less(b[1], a[3]) and less(a[2], b[4]) and less(b[2], a[4]))
        left = layer.join(spark.createDataFrame([(a[0],) for a in made[::2]], "id long"), "id", "left_semi")
        got = sorted((r["l"]["id"], r["r"]["id"]) for r in spatial.mixed_box_pairs(left, layer, 64, touching).collect())
        assert got == want and want
