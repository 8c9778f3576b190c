"""Outlines of regions: rings of corner points, shells and holes, traced without a walk along any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Sides of a cell as directed edges with the cell on their left (y grows downwards): step to the neighbour, begin, end.
_SIDES = (((-1, 0), (0, 1), (0, 0)), ((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)))


def _edge_id(r: Column, c: Column, side: Column) -> Column:
    """A number of its own for every side of every cell of rows within 2**29 of 0."""
    return F.shiftleft(r.cast("long"), 34) + F.shiftleft(c.cast("long").bitwiseAND(0xFFFFFFFF), 2) + side


def boundary(cells: DataFrame, region: str = "region") -> DataFrame:
    """region, id, next, y1, x1, y2, x2, turns: the unit edges between a region's cells and all that isn't the region, each with its only successor.

    cells: r, c and region, a row each. At a point where two cells of a region meet only by their corners an edge goes on along its own
    cell, as a region's cells hang together by sides. turns: the successor has another direction.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "ay", "ax", "by", "bx"), (*step, *a, *b), strict=True)]) for k, (step, a, b) in enumerate(_SIDES)]))
    own = cells.select("r", "c", F.col(region).alias("region"))
    sided = own.select("r", "c", "region", sides.alias("s")).select("*", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    beyond = own.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("region").alias("other"))
    free = sided.join(beyond, ["nr", "nc"], "left").where("other is null or other <> region")
    edges = written(free.select(
        "region", _edge_id(F.col("r"), F.col("c"), F.col("s.k")).alias("id"), F.struct("r", "c").alias("cell"), F.col("s.k").alias("k"),
        (F.col("r") + F.col("s.ay")).alias("y1"), (F.col("c") + F.col("s.ax")).alias("x1"), (F.col("r") + F.col("s.by")).alias("y2"), (F.col("c") + F.col("s.bx")).alias("x2"),
    ), "edges")
    after = edges.select("region", F.col("y1").alias("y2"), F.col("x1").alias("x2"), F.struct("cell", "k", "id").alias("n"))
    both = edges.join(after, ["region", "y2", "x2"])  # two successors at most
    best = both.groupBy("region", "id", "k", "y1", "x1", "y2", "x2").agg(F.min_by("n", F.when(F.col("n.cell") == F.col("cell"), 0).otherwise(1)).alias("n"))
    return best.select("region", "id", F.col("n.id").alias("next"), "y1", "x1", "y2", "x2", (F.col("n.k") != F.col("k")).alias("turns"))


def ring_points(cells: DataFrame, region: str = "region") -> DataFrame:
    """region, ring, k, y, x: the corners of every ring in order, k from 0; ring is the least edge of it.

    List ranking: every edge holds the least edge among those up to its pointer and how far ahead that lies; each round it
    takes over what its pointer's edge holds and doubles its reach. After as many rounds as the longest ring's length has
    binary digits nothing changes: the least edge names the ring, the way to it gives the place. A ring is never one task's.
    """
    edges = written(boundary(cells, region), "outline")
    state = written(edges.select("id", F.col("next").alias("jump"), F.col("id").alias("least"), F.lit(0).cast("long").alias("ahead")), "ranks")
    reach = 1
    while True:
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"), F.col("ahead").alias("_ahead"))
        nearer = F.col("least") <= F.col("_least")
        step = state.join(far, "jump").select("id", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"), F.when(nearer, F.col("ahead")).otherwise(F.col("_ahead") + reach).alias("ahead"), (F.col("_least") < F.col("least")).alias("moved"))
        step = written(step, "ranks")
        state, reach = step.drop("moved"), reach * 2
        if step.where("moved").isEmpty():
            break
    # A corner is the end of an edge that turns; places count down towards the least edge.
    corners = edges.where("turns").join(state.select("id", F.col("least").alias("ring"), "ahead"), "id")
    return corners.select("region", "ring", (-F.col("ahead")).alias("_place"), F.col("y2").alias("y"), F.col("x2").alias("x"))


def rings(cells: DataFrame, region: str = "region") -> DataFrame:
    """region, ring, corners, hole, area (in cells, below 0 for a hole), outline (points x, y, closed): a row for every ring of every region."""
    p = ring_points(cells, region)
    line = p.groupBy("region", "ring").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "x", "y"))), lambda e: F.struct(e["x"].cast("double").alias("x"), e["y"].cast("double").alias("y"))).alias("points"))
    closed = line.select("region", "ring", F.size("points").alias("corners"), F.concat("points", F.slice("points", 1, 1)).alias("outline"))
    # y grows downwards, so a shell, with its cells on the left, has an area below 0 by the shoelace formula.
    steps = F.transform(F.sequence(F.lit(1), F.size("outline") - 1), lambda i: F.element_at("outline", i)["y"] * F.element_at("outline", i + 1)["x"] - F.element_at("outline", i)["x"] * F.element_at("outline", i + 1)["y"])
    area = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / 2
    return closed.select("region", "ring", "corners", (area < 0).alias("hole"), area.cast("long").alias("area"), "outline")


def with_holes(cells: DataFrame, region: str = "region") -> DataFrame:
    """region, shell, holes (array of rings), cells: one polygon for each region, which has one shell as its cells hang together by sides."""
    r = rings(cells, region)
    shape = r.groupBy("region").agg(F.max(F.when(~F.col("hole"), F.col("outline"))).alias("shell"), F.collect_list(F.when(F.col("hole"), F.struct("ring", "outline"))).alias("_h"), F.sum("area").alias("cells"))
    return shape.select("region", "shell", F.transform(F.sort_array("_h"), lambda h: h["outline"]).alias("holes"), "cells")
