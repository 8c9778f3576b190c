"""Joins of boxes and points by grid cells: a theta join becomes an equi-join on the cell, then the exact predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def in_cells(boxes: DataFrame, size: float, margin: float = 0) -> DataFrame:
    """boxes with gx, gy of every cell that they touch, grown by margin."""
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low) - margin, size), _cell(F.col(high) + margin, size)))
    return boxes.withColumn("gx", span("xmin", "xmax")).withColumn("gy", span("ymin", "ymax"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by keys into as many parts as the session has for shuffles.

    A row that became many in an explode is taken for one by Spark's estimate, so it would broadcast a table that
    doesn't fit or leave all of a small file's work to one task. Joins of dealt rows take the hint merge for that reason.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _starts(low: str, high: str, size: float, own: int, other: int) -> Column:
    """3 * cell + kind of a side from low to high: kinds 0 and own in the cell where it starts, other in the cells that it goes on to."""
    first, last = _cell(F.col(low), size), _cell(F.col(high), size)
    on = F.transform(F.sequence(first + 1, F.greatest(last, first + 1)), lambda g: 3 * g + other)
    return F.explode(F.concat(F.array(3 * first, 3 * first + own), F.when(last > first, on).otherwise(F.array().cast("array<bigint>"))))


def box_pairs(left: DataFrame, right: DataFrame, size: float, touching: bool = False, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Pairs of structs l and r of overlapping boxes, each once. by: columns in which both agree. few: left has a bounded number of rows, which go to all tasks, and right stays where it is.

    A pair meets in the cell with the lower left corner of its intersection. In each direction it has one of three kinds
    there (0: both start in the cell, 1: only l does, 2: only r does), and the kinds belong to the join's key, so that two
    boxes that go on in a cell in one direction never meet there and no shuffle makes pairs distinct. size is about a
    large box's side; cells are a quarter of it. A box becomes a dozen rows before the join's shuffle: layers from small
    files should be dealt out.
    """
    fine = size / 4

    def placed(layer: DataFrame, name: str, own: int, other: int) -> DataFrame:
        x = layer.withColumn("_gx", _starts("xmin", "xmax", fine, own, other))
        both = x.withColumn("_gy", _starts("ymin", "ymax", fine, own, other))
        return both.select(F.struct(*layer.columns).alias(name), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_gx", "_gy")

    keys = [*[f"_by{i}" for i in range(len(by))], "_gx", "_gy"]
    less = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
    overlap = less(F.col("l.xmin"), F.col("r.xmax")) & less(F.col("r.xmin"), F.col("l.xmax")) & less(F.col("l.ymin"), F.col("r.ymax")) & less(F.col("r.ymin"), F.col("l.ymax"))
    l, r = placed(left, "l", 1, 2), placed(right, "r", 2, 1)
    met = F.broadcast(l).join(r, keys) if few else dealt(l, *keys).hint("merge").join(dealt(r, *keys), keys)
    return met.where(overlap).select("l", "r")


#: Cells of the coarsest level are so many doublings larger than the finest.
_COARSEST = 40


def mixed_box_pairs(left: DataFrame, right: DataFrame, size: float, touching: bool = False) -> DataFrame:
    """box_pairs for layers of very different sizes: cells come in levels, each twice as wide as the one before.

    A box's own level is the first whose cells are as long as its longer side, so that it touches four of them at most. A
    pair meets at the coarser of both own levels: a box goes to its own level's cells and to those of coarser levels that
    are own levels of the other layer, which one look at both layers tells. So a country among houses makes no row for each block.
    """
    longest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).cast("double")
    own = F.when(longest > size, F.least(F.ceil(F.log2(longest / size)), F.lit(_COARSEST))).otherwise(0).cast("int")
    present = [sorted(r["own"] for r in d.select(own.alias("own")).distinct().collect() if r["own"] is not None) for d in (left, right)]  # _COARSEST + 1 numbers at most

    def placed(layer: DataFrame, name: str, others: list[int]) -> DataFrame:
        coarser = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_own"))
        at = layer.withColumn("_own", own).withColumn("_level", F.explode(F.concat(F.array("_own"), coarser))).withColumn("_wide", size * F.pow(F.lit(2.0), F.col("_level")))
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_wide")).cast("long"), F.floor(F.col(high) / F.col("_wide")).cast("long")))
        at = at.withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax"))
        cells = at.select(F.struct(*layer.columns).alias(name), F.col("_own").alias(f"own_{name}"), F.col("_level").alias("level"), F.col("_wide").alias(f"wide_{name}"), F.col("_gx").alias("gx"), F.col("_gy").alias("gy"))
        return dealt(cells, "level", "gx", "gy")

    both = placed(left, "l", present[1]).hint("merge").join(placed(right, "r", present[0]), ["level", "gx", "gy"]).where(F.col("level") == F.greatest("own_l", "own_r"))
    less = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
    overlap = less(F.col("l.xmin"), F.col("r.xmax")) & less(F.col("r.xmin"), F.col("l.xmax")) & less(F.col("l.ymin"), F.col("r.ymax")) & less(F.col("r.ymin"), F.col("l.ymax"))
    corner = (F.col("gx") == F.floor(F.greatest("l.xmin", "r.xmin") / F.col("wide_l"))) & (F.col("gy") == F.floor(F.greatest("l.ymin", "r.ymin") / F.col("wide_l")))
    return both.where(overlap & corner).select("l", "r")


def intersection(l: str = "l", r: str = "r") -> dict[str, Column]:
    """Sides of the intersection of a pair of boxes."""
    return {s: (F.greatest if "min" in s else F.least)(f"{l}.{s}", f"{r}.{s}") for s in SIDES}


def box_area(sides: dict[str, Column]) -> Column:
    return (sides["xmax"] - sides["xmin"]) * (sides["ymax"] - sides["ymin"])


def points_in_boxes(points: DataFrame, x: str, y: str, boxes: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """points joined with the boxes that hold them; lower and left edges are in, others out."""
    held = in_cells(boxes, size)
    on = (_cell(F.col(x), size) == F.col("gx")) & (_cell(F.col(y), size) == F.col("gy")) & (F.col(x) >= F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) >= F.col("ymin")) & (F.col(y) < F.col("ymax"))
    return points.join(held, on, how).drop("gx", "gy")


def within_distance(boxes: DataFrame, points: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Pairs of structs l (a box) and r (a point: x, y) no farther apart than radius. size: of cells, about half of a large box's side."""
    size = size or max(radius, 1)
    l = dealt(in_cells(boxes, size, radius).select(F.struct(*boxes.columns).alias("l"), "gx", "gy"), "gx", "gy")
    r = dealt(points.select(F.struct(*points.columns).alias("r"), _cell(F.col("x"), size).alias("gx"), _cell(F.col("y"), size).alias("gy")), "gx", "gy")
    dx = F.greatest(F.col("l.xmin") - F.col("r.x"), F.col("r.x") - F.col("l.xmax"), F.lit(0))
    dy = F.greatest(F.col("l.ymin") - F.col("r.y"), F.col("r.y") - F.col("l.ymax"), F.lit(0))
    return l.hint("merge").join(r, ["gx", "gy"]).where(dx * dx + dy * dy <= radius * radius).select("l", "r")
