"""Layers of rings: exact relations of two layers, convex clipping, scan-line filling.

A ring is an array of struct<x, y> whose last point is its first. Coordinates are doubles; all tests of sides are products
of differences, which are exact for whole numbers below 2**25.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..scratch import written
from . import ringcells, ringpairs, spatial

#: A contact's place along an edge is told from the next one above this share of the edge.
_NEAR = 1e-12

#: Corners of features that are told pair by pair: 64 squared pairs of edges at most.
_FEW = 64


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once: a generator of one row stands between them and whatever uses them, across which Spark copies no expression."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select(*[F.col(f"`{c}`") for c in rows.columns], "_once.*")


def edges(ring: Column) -> Column:
    """The edges (x1, y1, x2, y2) of a path, without those of no length."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    all_of = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return F.when(F.size(ring) >= 2, F.filter(all_of, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])))


def counter_clockwise(ring: Column) -> Column:
    return F.when(g.signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def along_cells(rows: DataFrame, size: float) -> DataFrame:
    """rows with an edge (x1, y1, x2, y2), with gx, gy of the cells along it: a column of cells at a time, so that a long slanting edge goes to the cells near it, not to its whole box."""
    slack = 1e-6 * size
    cell = lambda v: F.floor(v / size).cast("long")
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = rows.withColumn("gx", F.explode(F.sequence(cell(low - slack), cell(high + slack))))
    y_at = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    a, b = y_at(F.greatest(low, F.col("gx") * size - slack)), y_at(F.least(high, (F.col("gx") + 1) * size + slack))
    first, last = F.coalesce(F.least(a, b), F.least("y1", "y2")), F.coalesce(F.greatest(a, b), F.greatest("y1", "y2"))
    return columns.withColumn("gy", F.explode(F.sequence(cell(first - slack), cell(last + slack))))


def _side(e: str, x: Column, y: Column) -> Column:
    """Above 0 where the point lies left of the edge, 0 on its line."""
    return (F.col(f"{e}.x2") - F.col(f"{e}.x1")) * (y - F.col(f"{e}.y1")) - (F.col(f"{e}.y2") - F.col(f"{e}.y1")) * (x - F.col(f"{e}.x1"))


def _contacts(e: str, o: str) -> Column:
    """Where the edges e and o share points: the places along e (0 its first point, 1 its last), empty if they share none.

    A place at a corner of o is always that corner's projection, and one at an end of e is 0 or 1, so that the two
    edges of a corner name the same place.
    """
    x1, y1, x2, y2 = (F.col(f"{e}.{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    first, last = _side(o, x1, y1), _side(o, x2, y2)
    other = [(F.col(f"{o}.x{i}"), F.col(f"{o}.y{i}")) for i in (1, 2)]
    sides = [_side(e, x, y) for x, y in other]
    between = lambda x, y, s: x.between(F.least(f"{s}.x1", f"{s}.x2"), F.greatest(f"{s}.x1", f"{s}.x2")) & y.between(F.least(f"{s}.y1", f"{s}.y2"), F.greatest(f"{s}.y1", f"{s}.y2"))
    ends = [F.when((v == 0) & between(x, y, o), F.lit(t)) for v, x, y, t in ((first, x1, y1, 0.0), (last, x2, y2, 1.0))]
    corners = [F.when((s == 0) & between(x, y, e), ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)) for s, (x, y) in zip(sides, other, strict=True)]
    proper = (F.signum(first) * F.signum(last) < 0) & (F.signum(sides[0]) * F.signum(sides[1]) < 0)
    return F.when(proper, F.array(first / (first - last))).otherwise(F.array_compact(F.array(*ends, *corners)))


def _turned(rings: Column) -> Column:
    """A shell and its holes with the inside to the left of every edge: the shell counter-clockwise, holes the other way. Holes without an area go."""
    whole = F.concat(F.slice(rings, 1, 1), F.filter(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(0))), g.valid))
    return F.transform(whole, lambda ring, i: F.when((g.signed_area(ring) < 0) == (i == 0), F.reverse(ring)).otherwise(ring))


def _inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of the rings hold the point."""
    return F.aggregate(rings, F.lit(False), lambda odd, ring: odd != g.contains(ring, x, y))


def relate(left: DataFrame, right: DataFrame, size: float, lines: bool = False, match: str | None = None, flags: bool = True) -> DataFrame:
    """l, r, contact, l_in, l_out, r_in, r_out, same: how every two features whose bounds touch lie to each other, in one row.

    left and right: key (one row each) and ring, or rings instead: an array of a shell and its holes, which lie within it and
    leave the feature in one piece; lines: left has open paths in ring instead. in and out say that a part of a
    boundary (or line) lies strictly inside or outside the other feature, same that both boundaries share a part with their insides
    on one side. Rings without an area take no part; rings that cross themselves have no defined result.

    match: only pairs that fit it (see matches). flags: whether the flags are wanted, or l and r alone.

    Pairs of features of at most _FEW corners are told where they meet, and rings go to no row of a pair (ringcells). Others
    go by their edges, so that only near edges meet.
    """
    prepared, holes = [], "rings" in left.columns or "rings" in right.columns
    for layer, open_paths in ((left, lines), (right, False)):
        # Dealt out before anything is computed of a ring: a small file is one task's.
        layer = spatial.dealt(layer.select("key", (F.col("rings") if "rings" in layer.columns else F.array("ring")).alias("rings")), "key")
        paths, first = F.col("rings"), F.get("rings", F.lit(0))
        good = (F.size(F.coalesce(edges(first), F.array())) > 0) if open_paths else g.valid(first)
        kept = layer.where(good).select("key", (paths if open_paths else _turned(paths)).alias("rings"))
        xs, ys = F.transform(F.get("rings", F.lit(0)), lambda p: p["x"]), F.transform(F.get("rings", F.lit(0)), lambda p: p["y"])
        sides = [f(v).alias(n) for f, v, n in ((F.array_min, xs, "xmin"), (F.array_min, ys, "ymin"), (F.array_max, xs, "xmax"), (F.array_max, ys, "ymax"))]
        few = F.size(F.flatten("rings")) <= _FEW
        prepared.append(written(kept.select("key", "rings", *sides, few.alias("few")), "rings"))
    (l, l_few, l_many), (r, r_few, r_many) = [(p.drop("few"), p.where("few").drop("few"), p.where("not few").drop("few")) for p in prepared]
    keep = None if match is None else lambda flags: _matched(flags, match, lines, np.zeros(1, bool))
    told = ringcells.related(_NEAR, lines, keep, flags, touching=match == "intersects")
    bounds = {"contains": "contain", "within": "within"}.get(match, "touch") if not lines else "touch"
    small = [d.withColumnRenamed("rings", "paths") for d in (l_few, r_few)]
    found = ringcells.pairs(*small, size, told, ringcells.FLAG_COLUMNS if flags else [], not lines, bounds)
    for a, b in ((l_many, r), (l_few, r_many)):
        if not (l_many if a is l_many else r_many).isEmpty():
            more = _by_edges(a, b, size, lines, holes)
            more = more if match is None else more.where(matches(match, lines))
            found = found.unionByName(more if flags else more.select("l", "r"))
    return found


def _by_edges(l: DataFrame, r: DataFrame, size: float, lines: bool, holes: bool) -> DataFrame:
    """relate of prepared layers (key, rings, sides) by joins of their edges.

    Edges are dealt to the cells along them and joined there, so that only near edges meet. Every contact cuts its edges; a
    piece between two cuts lies inside, outside or along, told by its middle. A part of a ring between two contacts ends
    on an edge with a contact, so edges without one need no look. Rings without a contact are told by one point of each.
    """
    parts = F.flatten(F.transform("rings", lambda ring, i: F.transform(edges(ring), lambda e: F.struct(i.alias("part"), *[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")]))))
    dealt = [along_cells(p.select("key", F.posexplode(parts).alias("at", "e")).select("key", "at", "e.*"), size) for p in (l, r)]
    packed = [spatial.dealt(d.select(F.struct("key", "part", "at", "x1", "y1", "x2", "y2").alias(n), "gx", "gy"), "gx", "gy") for d, n in zip(dealt, "lr", strict=True)]
    near = (F.least("l.x1", "l.x2") <= F.greatest("r.x1", "r.x2")) & (F.least("r.x1", "r.x2") <= F.greatest("l.x1", "l.x2")) & (F.least("l.y1", "l.y2") <= F.greatest("r.y1", "r.y2")) & (F.least("r.y1", "r.y2") <= F.greatest("l.y1", "l.y2"))
    met = once(packed[0].hint("merge").join(packed[1], ["gx", "gy"]).where(near).select("l", "r"), cl=_contacts("l", "r"), cr=_contacts("r", "l")).where("size(cl) > 0")
    dot = (F.col("l.x2") - F.col("l.x1")) * (F.col("r.x2") - F.col("r.x1")) + (F.col("l.y2") - F.col("l.y1")) * (F.col("r.y2") - F.col("r.y1"))
    along = (F.array_max("cl") - F.array_min("cl") > _NEAR) & (F.array_max("cr") - F.array_min("cr") > _NEAR)
    met = written(met.withColumns({"along": along, "same": along & (dot > 0)}), "contacts")

    def pieces(own: str, other: str, places: str, rings: DataFrame) -> DataFrame:
        """l, r, in, out of the pieces of own's edges with contacts, against other's rings."""
        on = F.when(F.col("along"), F.struct(F.array_min(places).alias("a"), F.array_max(places).alias("b")))
        cut = met.groupBy(F.col("l.key").alias("l"), F.col("r.key").alias("r"), F.col(own).alias("e")).agg(F.flatten(F.collect_set(places)).alias("at"), F.collect_set(on).alias("on"))
        at = F.array_sort(F.array_distinct(F.concat("at", F.array(F.lit(0.0), F.lit(1.0)))))
        cut = once(cut, cuts=at)
        steps = F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        free = F.filter(steps, lambda s: (s["b"] - s["a"] > _NEAR) & ~F.exists("on", lambda o: (o["a"] <= (s["a"] + s["b"]) / 2) & (o["b"] >= (s["a"] + s["b"]) / 2)))
        middle = cut.select("l", "r", "e", F.explode(F.transform(free, lambda s: (s["a"] + s["b"]) / 2)).alias("t"))
        x, y = F.col("e.x1") + F.col("t") * (F.col("e.x2") - F.col("e.x1")), F.col("e.y1") + F.col("t") * (F.col("e.y2") - F.col("e.y1"))
        inside = _inside(F.col("rings"), x, y)
        return middle.join(rings.select(F.col("key").alias(other), "rings"), other).select("l", "r", inside.alias("in"))

    flag = lambda c, n: F.coalesce(F.bool_or(c), F.lit(False)).alias(n)
    touched = met.groupBy(F.col("l.key").alias("l"), F.col("r.key").alias("r")).agg(flag(F.col("same"), "same"), *[F.collect_set(f"{n}.part").alias(f"{n}_parts") for n in "lr" if holes])
    sided = pieces("l", "r", "cl", r).select("l", "r", F.col("in").alias("l_in"), (~F.col("in")).alias("l_out"), F.lit(False).alias("r_in"), F.lit(lines).alias("r_out"))
    if not lines:
        sided = sided.union(pieces("r", "l", "cr", l).select("l", "r", F.lit(False), F.lit(False), F.col("in"), ~F.col("in")))
    sums = sided.groupBy("l", "r").agg(*[flag(F.col(c), c) for c in ("l_in", "l_out", "r_in", "r_out")])
    of_contacts = touched.join(sums, ["l", "r"], "left").select("l", "r", F.lit(True).alias("contact"), *[F.coalesce(c, F.lit(lines and c == "r_out")).alias(c) for c in ("l_in", "l_out", "r_in", "r_out")], "same")

    starts = F.transform("rings", lambda ring, i: F.struct(i.alias("part"), F.get(ring, F.lit(0)).alias("p")))
    boxes = [p.select("key", *spatial.SIDES, starts.alias("p")) for p in (l, r)]
    rest = spatial.mixed_box_pairs(boxes[0], boxes[1], size, touching=True).select(F.col("l.key").alias("l"), F.col("r.key").alias("r"), F.col("l.p").alias("pl"), F.col("r.p").alias("pr"))
    if holes:
        alone = lambda n: F.filter(f"p{n}", lambda p: ~F.array_contains(F.coalesce(f"{n}_parts", F.array().cast("array<int>")), p["part"])).alias(f"p{n}")
        rest = rest.join(touched.select("l", "r", "l_parts", "r_parts"), ["l", "r"], "left").select("l", "r", alone("l"), alone("r")).where("size(pl) + size(pr) > 0")
    else:
        rest = rest.join(touched.select("l", "r"), ["l", "r"], "left_anti")

    def held(rows: DataFrame, other: str, rings: DataFrame, p: str) -> DataFrame:
        """rows with p_in and p_out: whether a first point of p lies in or out of other."""
        of = once(rows.join(rings.select(F.col("key").alias(other), "rings"), other), _held=F.transform(p, lambda s: _inside(F.col("rings"), s["p"]["x"], s["p"]["y"])))
        return of.withColumns({f"{p}_in": F.array_contains("_held", True), f"{p}_out": F.array_contains("_held", False)}).drop("rings", "_held")

    rest = held(rest, "r", r, "pl")
    rest = rest.withColumns({"pr_in": F.lit(False), "pr_out": F.lit(True)}) if lines else held(rest, "l", l, "pr")
    apart = rest.select("l", "r", F.lit(False).alias("contact"), F.col("pl_in").alias("l_in"), F.col("pl_out").alias("l_out"), F.col("pr_in").alias("r_in"), F.col("pr_out").alias("r_out"), F.lit(False).alias("same"))
    found = of_contacts.unionByName(apart)
    # A ring of a feature may have contacts where another has none.
    return found.groupBy("l", "r").agg(*[F.bool_or(c).alias(c) for c in found.columns[2:]]) if holes else found


def matches(match: str, lines: bool = False) -> Column:
    """Whether a row of relate fits intersects, contains, within, touches, crosses, overlaps, equals or disjoint (of pairs whose bounds touch), as simple-feature relations have it.

    A feature that meets another's inside is within it if the other's boundary, that of holes included, has no part inside.
    Two areas never cross; a line crosses an area if it has parts inside and outside, and is within if it has one inside and none outside.
    """
    return _matched({c: F.col(c) for c in ringpairs.FLAGS}, match, lines, F.lit(False))


def _matched(flags: dict, match: str, lines: bool, never):
    """matches for flags that are columns or arrays; never is one that doesn't hold."""
    l_in, l_out, r_in, r_out = (flags[c] for c in ("l_in", "l_out", "r_in", "r_out"))
    shared = flags["contact"] | l_in | r_in
    inner = l_in if lines else l_in | r_in | flags["same"]
    never = never & shared
    return {
        "intersects": shared,
        "disjoint": ~shared,
        "touches": shared & ~inner,
        "contains": never if lines else inner & ~r_out & ~l_in,
        "within": (l_in & ~l_out) if lines else inner & ~l_out & ~r_in,
        "crosses": (l_in & l_out) if lines else never,
        "overlaps": never if lines else inner & (l_out | r_in) & (r_out | l_in),
        "equals": never if lines else inner & ~l_out & ~r_out & ~l_in & ~r_in,
    }[match]


def join(left: DataFrame, right: DataFrame, on: tuple[str, str], match: str = "intersects", how: str = "inner", size: float = 64, lines: bool = False) -> DataFrame:
    """Structs l and r of the features that match (see matches); how left keeps those of left without one, r null.

    on: the key of each layer, one row each; both layers have their rings in column ring, or shells with holes in rings, and may have any others.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    keyed = [d.select(F.col(k).alias("key"), "rings" if "rings" in d.columns else "ring") for d, k in zip((left, right), on, strict=True)]
    pairs = relate(*keyed, size, lines, match, flags=False).select(F.col("l").alias("_l"), F.col("r").alias("_r"))
    l, r = left.select(F.struct(*left.columns).alias("l")), right.select(F.struct(*right.columns).alias("r"))
    found = pairs.join(r, F.col("_r") == F.col(f"r.{on[1]}"))
    return l.join(found, F.col(f"l.{on[0]}") == F.col("_l"), how).select("l", "r")


def reprojected(ring: Column, project) -> Column:
    """A ring with project(x, y) of every point, e.g. geometry.to_mercator."""
    return F.transform(ring, lambda p: g.point(*project(p["x"], p["y"])))


# -- convex clipping


def _half_plane(x: np.ndarray, y: np.ndarray, n: np.ndarray, e: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of open paths of n corners each, one after the other in x and y, left of the line of their edge e (x1, y1, x2, y2), cut where they cross."""
    x1, y1, x2, y2 = e
    first = np.cumsum(n) - n
    d = np.repeat(x2 - x1, n) * (y - np.repeat(y1, n)) - np.repeat(y2 - y1, n) * (x - np.repeat(x1, n))
    after = np.arange(1, len(x) + 1)
    some = n > 0
    after[(first + n - 1)[some]] = first[some]
    qd = d[after]
    stays = qd >= 0
    crossed = ((d > 0) & ~stays) | ((d < 0) & (qd > 0))
    out = np.add(crossed, stays, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(out)])
    xs, ys = np.empty(ends[-1]), np.empty(ends[-1])
    cut, kept = np.flatnonzero(crossed), np.flatnonzero(stays)
    q = after[cut]
    t = d[cut] / (d[cut] - qd[cut])
    xs[ends[cut]], ys[ends[cut]] = x[cut] + t * (x[q] - x[cut]), y[cut] + t * (y[q] - y[cut])
    q, at = after[kept], ends[kept + 1] - 1
    xs[at], ys[at] = x[q], y[q]
    return xs, ys, ends[first + n] - ends[first]


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y of all corners of an array of paths, and their number in each."""
    points = rings.flatten()
    return *(points.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)), pc.list_value_length(rings).to_numpy(zero_copy_only=False)


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _clipped(rings: Column, mask: Column) -> Column:
    """The corners of each ring's part within a convex mask that runs counter-clockwise."""
    return F.arrow_udf(_clipped_batch, "array<array<struct<x:double,y:double>>>")(rings, mask)


def _clipped_batch(rings: pa.Array, masks: pa.Array) -> pa.Array:
    """_clipped for a batch: all its rings are cut by their masks' next side at once."""
    of = pc.list_value_length(rings).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(of)), of)
    x, y, n = _flat(rings.flatten())
    last = np.cumsum(n)[n > 0] - 1
    open_ends = np.ones(len(x), bool)
    open_ends[last] = False
    x, y, n = x[open_ends], y[open_ends], np.maximum(n - 1, 0)
    mx, my, sides = _flat(masks)
    begin = np.cumsum(sides) - sides
    for k in range(max(sides.max(initial=0) - 1, 0)):
        at = np.where(k + 1 < sides, begin + k, -1)[row]
        has = at >= 0
        at, to = np.where(has, at, 0), np.where(has, at + 1, 0)
        e = mx[at], my[at], mx[to], my[to]
        # A side of no length, and so one that the mask doesn't have, leaves what is there: all corners lie on its line.
        x, y, n = _half_plane(x, y, n, e)
    inner = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(_POINT)))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(of)]).astype(np.int32), inner)


def clip_convex(ring: Column, mask: Column) -> Column:
    """The part of ring within a convex mask, closed; null where they share no area. Of a ring with bays the part may hang together by edges of no width; its area is exact."""
    closed = _closed(F.get(_clipped(F.array(ring), counter_clockwise(mask)), F.lit(0)))
    return F.when(g.area(closed) > 0, closed)


def _closed(path: Column) -> Column:
    return F.when(F.size(path) > 2, F.concat(path, F.slice(path, 1, 1)))


def overlay(left: DataFrame, right: DataFrame, size: float = 64, least_area: float = 0.0) -> DataFrame:
    """l, r, ring, area: the shared part, above least_area, of every ring of left with every convex ring of right.

    Where left has rings instead (a shell and its holes), so has the result: the parts of the shell and of the holes within
    the mask, whose even-odd fill is the shared part. Holes without a part there go.
    """
    holes = "rings" in left.columns
    shells, paths = (F.get("rings", F.lit(0)), _turned(F.col("rings"))) if holes else (F.col("ring"), F.array("ring"))
    rows = []
    for layer, shell, path in ((left, shells, paths), (right, F.col("ring"), counter_clockwise(F.col("ring")))):
        sides = dict(zip(spatial.SIDES, g.bounds(shell), strict=True))
        rows.append(layer.where(g.valid(shell)).select(F.struct(*layer.columns).alias("feature"), path.alias("path"), *[v.alias(k) for k, v in sides.items()]))
    pairs = spatial.mixed_box_pairs(rows[0], rows[1], size).select(F.col("l.feature").alias("l"), F.col("r.feature").alias("r"), _clipped(F.col("l.path"), F.col("r.path")).alias("_paths")).where("size(_paths[0]) > 2")
    if holes:
        parts = once(pairs, _parts=F.transform("_paths", lambda p: F.struct(_closed(p).alias("ring"), F.coalesce(g.area(_closed(p)), F.lit(0.0)).alias("area"))))
        held = F.concat(F.slice("_parts", 1, 1), F.filter(F.slice("_parts", 2, F.size("_parts")), lambda p: p["area"] > 0))
        total = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0))["area"], lambda s, p: s - p["area"])
        cut = once(parts, rings=F.transform(held, lambda p: p["ring"]), area=total)
    else:
        cut = once(pairs, ring=_closed(F.get("_paths", F.lit(0))))
        cut = once(cut, area=g.area(F.col("ring")))
    return cut.where((F.col("area") > 0) & (F.col("area") > least_area)).select("l", "r", "rings" if holes else "ring", "area")


def _area_within(f: ringcells.Features, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The area of ring i of each pair within the convex mask j, by the cuts of _clipped; 0 where nothing is left."""
    first, mask = f.first_part[i], f.first_part[j]
    n, begin, sides = f.n[first] - 1, f.first[mask], f.n[mask]
    _, at = ringpairs.each(n, f.first[first])
    x, y = f.x[at], f.y[at]
    for k in range(int(sides.max(initial=1)) - 1):
        has = k + 1 < sides
        at, to = begin + np.where(has, k, 0), begin + np.where(has, k + 1, 0)
        x, y, n = _half_plane(x, y, n, (f.x[at], f.y[at], f.x[to], f.y[to]))
    some, after = n > 0, np.arange(1, len(x) + 1)
    last = np.cumsum(n)
    after[last[some] - 1] = (last - n)[some]
    total = np.bincount(np.repeat(np.arange(len(n)), n), weights=x * y[after] - x[after] * y, minlength=len(n))  # in order, as a fold has it
    return np.where(n > 2, np.abs(total / 2), 0.0)


def shared_areas(left: DataFrame, right: DataFrame, on: tuple[str, str], size: float = 64, least_area: float = 0.0) -> DataFrame:
    """l, r (the keys), area: overlay where only the areas are wanted, of rings (column ring) with convex ones, told where both meet."""
    layers = []
    for layer, k in zip((left, right), on, strict=True):
        layer = spatial.dealt(layer.select(F.col(k).alias("key"), "ring"), "key")
        path = F.col("ring") if not layers else counter_clockwise(F.col("ring"))
        sides = dict(zip(spatial.SIDES, g.bounds(F.col("ring")), strict=True))
        layers.append(written(layer.where(g.valid(F.col("ring"))).select("key", F.array(path).alias("paths"), *[v.alias(c) for c, v in sides.items()]), "rings"))

    def told(f: ringcells.Features, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        which = np.arange(len(i))
        if least_area > 0:  # else the last digits of rings that only touch decide
            x0, y0, x1, y1 = f.bounds
            wide, high = np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j]), np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])
            which = np.flatnonzero(wide * high * (1 + 1e-9) > least_area)
            if f.all_plain:
                which = which[~ringcells.beside(f, i[which], j[which])]
        steps = range(0, len(which), ringcells._PAIRS)
        areas = np.concatenate([np.zeros(0), *[_area_within(f, *(v[which[at : at + ringcells._PAIRS]] for v in (i, j))) for at in steps]])
        kept = (areas > 0) & (areas > least_area)
        return which[kept], [pa.array(areas[kept])]

    return ringcells.pairs(*layers, size, told, ringcells.AREA_COLUMNS, bounds="overlap")


def clip(layer: DataFrame, masks: DataFrame, size: float = 64) -> DataFrame:
    """layer's columns with their rings (ring, or shell and holes in rings) cut to convex masks, a row for each mask that a feature meets. An empty layer and an empty result are errors."""
    if layer.isEmpty():
        raise ValueError("the layer is empty")
    cut, path = overlay(layer, masks, size), "rings" if "rings" in layer.columns else "ring"
    found = written(cut.select(*[F.col(path) if c == path else F.col(f"l.{c}").alias(c) for c in layer.columns]), "clipped")
    if found.isEmpty():
        raise ValueError("no feature meets the mask")
    return found


# -- rasters of rings


def runs(rings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, r, c0, c1: the cells c0..c1 of row r whose centres (c + 0.5, r + 0.5) lie in a feature, by the even-odd rule over all rings of by (shells and holes).

    Every edge gives its crossing of the rows of centres between its ends, lower end in, upper end out; a row's crossings
    in order are ends of runs by turns. A centre on a left edge is in, on a right edge out.
    """
    e = rings.select(*by, F.explode(edges(F.col("ring"))).alias("e")).select(*by, "e.*")
    first = F.ceil(F.least("y1", "y2") - 0.5).cast("int")
    last = (F.ceil(F.greatest("y1", "y2") - 0.5) - 1).cast("int")
    rows = e.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("r"))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    ends = rows.select(*by, "r", F.ceil(x - 0.5).cast("int").alias("c")).groupBy(*by, "r").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.struct(F.get("c", i).alias("c0"), (F.get("c", i + 1) - 1).alias("c1"))))
    return ends.select(*by, "r", pair.alias("_p")).select(*by, "r", "_p.*").where("c0 <= c1")


def rasterized(rings: DataFrame, by: str, value: str, order: Column, names: Sequence[str] | None = None, single: int | None = None) -> DataFrame:
    """r, c, value: every cell takes the value of the last feature, by order, that covers it.

    names: value holds class names; these are 1, 2, ... in turn, other classes 0. All must occur, as the reference has it.
    single: one value for all cells that aren't 0.
    """
    layer = rings
    if names is not None:
        missing = set(names) - {x[0] for x in layer.where(F.col(value).isin(*names)).select(value).distinct().collect()}  # names at most
        if missing:
            raise ValueError(f"no feature has class {sorted(missing)}")
        code = F.lit(0)
        for i, name in enumerate(names):
            code = F.when(F.col(value) == name, i + 1).otherwise(code)
        layer = layer.withColumn(value, code)
    facts = layer.groupBy(by).agg(F.first(value).alias("_value"), F.first(order).alias("_order"))
    # Equal runs of many features leave one before they become cells.
    rows = spatial.dealt(runs(spatial.dealt(layer.select(by, "ring"), by), [by]), by).hint("merge").join(facts, by)
    top = rows.groupBy("r", "c0", "c1").agg(F.max_by(F.struct("_value", "_order", by), F.struct("_order", by)).alias("_top"))
    cells = top.select("r", F.explode(F.sequence("c0", "c1")).alias("c"), "_top.*")
    last = cells.groupBy("r", "c").agg(F.max_by("_value", F.struct("_order", by)).alias("value"))
    return last.withColumn("value", F.when(F.col("value") != 0, F.lit(single)).otherwise(F.col("value"))) if single is not None else last
