"""Geometry as column functions. A ring is an array of struct<x, y> whose last point is its first; a polygon an array of rings, outer first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
AUTHALIC = 6371007.1809


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The box counter-clockwise from its lower left corner."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def _edges(ring: Column, term) -> Column:
    """The sum of term(p, q) over the edges of a ring."""
    steps = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("q"))
    return F.aggregate(steps, F.lit(0.0), lambda s, e: s + term(e["p"], e["q"]))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def centroid(ring: Column) -> Column:
    a = signed_area(ring)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return point(_edges(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / (6 * a), _edges(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / (6 * a))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges cross the ray to the right. Points on a left or lower edge are in, on others out."""
    crosses = lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1.0).otherwise(0.0)
    return _edges(ring, crosses) % 2 == 1


def point_inside(ring: Column, middle: Column | None = None) -> Column:
    """A point within: the centroid, or where that lies outside the middle of the longest run of the horizontal line through it.

    middle: the centroid as a column, which spares making it again for every edge.
    """
    c = centroid(ring) if middle is None else middle
    x, y = c["x"], c["y"]
    ends = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i + 1).alias("q")))
    met = F.filter(ends, lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
    xs = F.array_sort(F.transform(met, lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    runs = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct((F.get(v, 2 * i + 1) - F.get(v, 2 * i)).alias("wide"), ((F.get(v, 2 * i + 1) + F.get(v, 2 * i)) / 2).alias("x")))
    longest = F.get(F.transform(F.array(xs), lambda v: F.array_max(runs(v))["x"]), F.lit(0))  # xs is made once
    return F.when(contains(ring, x, y), c).otherwise(point(longest, y))


def geodesic_area(ring: Column) -> Column:
    """Square metres of a lon/lat ring on the authalic sphere; edges follow constant sine of latitude between their ends, so long edges are approximate."""
    return F.abs(_edges(ring, lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"]))))) * AUTHALIC**2 / 2


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def valid(ring: Column) -> Column:
    """Closed, of four points or more, with an area."""
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & (area(ring) > 0), F.lit(False))


def circle(x: Column, y: Column, radius: Column, steps: int = 64) -> Column:
    """A point buffered: a ring of steps points, closed."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(x + radius * F.cos(2 * math.pi * (i % steps) / steps), y + radius * F.sin(2 * math.pi * (i % steps) / steps)))


def simplify(ring: Column, tolerance: float) -> Column:
    """Points snapped to a grid of tolerance; a point that repeats the one before goes."""
    snapped = F.transform(ring, lambda p: point(F.floor(p["x"] / tolerance + 0.5) * tolerance, F.floor(p["y"] / tolerance + 0.5) * tolerance))
    return F.filter(F.transform(snapped, lambda p, i: F.struct(p.alias("p"), (F.get(snapped, i - 1)).alias("before"))), lambda e: ~e["p"].eqNullSafe(e["before"]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (xmin, ymin, xmax, ymax)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    size = lambda s: (s[2] - s[0]) * (s[3] - s[1])
    return F.coalesce(F.try_divide((w * h).cast("double"), (size(a) + size(b) - w * h).cast("double")), F.lit(0.0))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the 256-pixel map tile at zoom; latitudes end at 85.05112878."""
    clipped = F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))
    s = F.sin(F.radians(clipped))
    n = 256 << zoom
    px = F.floor(F.greatest(F.least((lon + 180) / 360 * n + 0.5, F.lit(float(n - 1))), F.lit(0.0)))
    py = F.floor(F.greatest(F.least((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n + 0.5, F.lit(float(n - 1))), F.lit(0.0)))
    return F.floor(px / 256).cast("int"), F.floor(py / 256).cast("int")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """A digit 0..3 for each level: bit of x plus twice the bit of y."""
    digit = lambda i: (F.shiftright(x, i).bitwiseAND(1) + 2 * F.shiftright(y, i).bitwiseAND(1)).cast("string")
    return F.concat(*[digit(i) for i in range(zoom - 1, -1, -1)]) if zoom else F.lit("")


def tile_of_quadkey(key: Column) -> tuple[Column, Column]:
    bits = lambda odd: F.aggregate(F.filter(F.split(key, ""), lambda d: d != ""), F.lit(0), lambda s, d: 2 * s + (d.isin(*(["1", "3"] if not odd else ["2", "3"]))).cast("int"))
    return bits(False), bits(True)
