"""Rasters as pixel tables: one row a cell, a column a band."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles

CELL = ("r", "c")


def code(column: Column, mapping: Mapping[int, int]) -> Column:
    """Every code mapped at once; codes that aren't named stay."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def binarize(value: Column, least: float, on: int = 255) -> Column:
    return F.when(value >= least, on).otherwise(0)


def change(before: DataFrame, after: DataFrame, value: int, lost: int = 1, gained: int = 2) -> DataFrame:
    """r, c, change: lost where only before has value, gained where only after has, else 0; cells of either side."""
    b, a = before.select(*CELL, (F.col("cls") == value).alias("b")), after.select(*CELL, (F.col("cls") == value).alias("a"))
    was, now = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(False))
    return b.join(a, list(CELL), "full").select(*CELL, F.when(was & ~now, lost).when(now & ~was, gained).otherwise(0).alias("change"))


def transition(before: DataFrame, after: DataFrame, origins: Sequence[int], targets: Sequence[int], cloud: int = 5, on: int = 1) -> DataFrame:
    """r, c, code: on where a cell went from one of origins to one of targets; 0 elsewhere and under cloud."""
    both = before.select(*CELL, F.col("cls").alias("b")).join(after.select(*CELL, F.col("cls").alias("a")), list(CELL))
    hit = F.col("b").isin(*origins) & F.col("a").isin(*targets) & (F.col("b") != cloud) & (F.col("a") != cloud)
    return both.select(*CELL, F.when(hit, on).otherwise(0).alias("code"))


def difference(before: DataFrame, after: DataFrame, value: str, nodata: int = 0) -> DataFrame:
    """r, c, diff: after - before where both have data, else nodata; cells of both."""
    both = before.select(*CELL, F.col(value).alias("b")).join(after.select(*CELL, F.col(value).alias("a")), list(CELL))
    known = (F.col("b") != nodata) & (F.col("a") != nodata)
    return both.select(*CELL, F.when(known, F.col("a") - F.col("b")).otherwise(nodata).alias("diff"))


def subtract(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of mask that other doesn't have."""
    return mask.join(other.select(*CELL), list(CELL), "left_anti")


def patched(old: DataFrame, new: DataFrame, cloud: DataFrame) -> DataFrame:
    """r, c, cls, layer: the cells of new under cloud, and those of old that aren't."""
    under = cloud.select(*CELL).distinct()
    rest = old.select(*CELL, "cls", F.lit("old").alias("layer")).join(under, list(CELL), "left_anti")
    return rest.unionByName(new.select(*CELL, "cls", F.lit("new").alias("layer")).join(under, list(CELL), "left_semi"))


def over_time(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, f: Callable[[np.ndarray], float]) -> DataFrame:
    """by, n, result: a caller's function of each group's values in order, null as NaN. A group is one task's array."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values(list(order))[value].to_numpy(float, na_value=np.nan)
        return pd.DataFrame([(*group.iloc[0][list(by)], len(values), float(f(values)))], columns=[*by, "n", "result"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, *order, value).groupBy(*by).applyInPandas(solve, f"{types}, n long, result double")


def first_valid(scenes: DataFrame, order: Column, value: str, nodata: int = 0, by: Sequence[str] = CELL) -> DataFrame:
    """A mosaic: each cell's value in the first scene by order that has data there. One aggregate, combined before the shuffle."""
    return scenes.where(F.col(value) != nodata).groupBy(*by).agg(F.min_by(value, order).alias(value))


def last_layer(layers: DataFrame, order: Column, value: str = "cls") -> DataFrame:
    """The class of the last layer by order that isn't 0."""
    return layers.where(F.col(value) != 0).groupBy(*CELL).agg(F.max_by(value, order).alias(value))


def linear(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """value mapped from [low, high] to [to_low, to_high], clamped; to_low where the range is empty."""
    part = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.lit(to_low) + F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * (to_high - to_low)


def long_bands(px: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("scene_id", *CELL)) -> DataFrame:
    """keys, band, value: a row a cell and band."""
    return px.select(*keys, *bands).unpivot(list(keys), list(bands), "band", "value")


def limits(px: DataFrame, bands: Sequence[str], low: float = 0.02, high: float = 0.98, nodata: int = 0) -> DataFrame:
    """scene_id, band, p_low, p_high, vmin, vmax of the cells with data: exact percentiles, interpolated. The ends are the shares 0 and 1."""
    data = long_bands(px, bands).where(F.col("value") != nodata)
    p = percentiles(data, ["scene_id", "band"], "value", [low, high, 0.0, 1.0])
    return p.select("scene_id", "band", *[F.col("p")[i].alias(n) for i, n in enumerate(("p_low", "p_high", "vmin", "vmax"))])


def kernel(size: int, shape: str = "rect") -> list[tuple[int, int]]:
    """Offsets of a rect, cross or ellipse of odd size around its centre."""
    h = size // 2
    inside = {"rect": lambda y, x: True, "cross": lambda y, x: x == 0 or y == 0, "ellipse": lambda y, x: abs(x) <= round(((h * h - y * y) ** 0.5) if h else 0)}[shape]
    return [(y, x) for y in range(-h, h + 1) for x in range(-h, h + 1) if inside(y, x)]


def _spread(mask: DataFrame, offsets: Sequence[tuple[int, int]], value: str) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in offsets]))
    return mask.select(*CELL, value, steps.alias("_o")).select((F.col("r") + F.col("_o.y")).alias("r"), (F.col("c") + F.col("_o.x")).alias("c"), value)


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int]], value: str = "cls") -> DataFrame:
    """The greatest value in the kernel around each cell of mask; cells that mask lacks count for nothing and stay out."""
    near = _spread(mask, offsets, value).groupBy(*CELL).agg(F.max(value).alias("_v"))
    return mask.select(*CELL).join(near, list(CELL)).select(*CELL, F.col("_v").alias(value))


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int]], value: str = "cls") -> DataFrame:
    """The least value in the kernel around each cell of mask, as dilate."""
    near = _spread(mask, offsets, value).groupBy(*CELL).agg(F.min(value).alias("_v"))
    return mask.select(*CELL).join(near, list(CELL)).select(*CELL, F.col("_v").alias(value))


def opening(mask: DataFrame, offsets, value: str = "cls") -> DataFrame:
    return dilate(erode(mask, offsets, value), offsets, value)


def closing(mask: DataFrame, offsets, value: str = "cls") -> DataFrame:
    return erode(dilate(mask, offsets, value), offsets, value)


def gradient(mask: DataFrame, offsets, value: str = "cls") -> DataFrame:
    high, low = dilate(mask, offsets, value), erode(mask, offsets, value).withColumnRenamed(value, "_low")
    return high.join(low, list(CELL)).select(*CELL, (F.col(value) - F.col("_low")).alias(value))


def tile_windows(px: DataFrame, size: int, stride: int) -> DataFrame:
    """px with top and left of every window that covers a cell; windows start at multiples of stride, from 0."""
    starts = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride) + 1).cast("int"), F.floor(F.col(c) / stride).cast("int"))
    at = px.withColumn("top", F.explode(starts("r"))).withColumn("left", F.explode(starts("c")))
    return at.withColumns({"top": F.col("top") * stride, "left": F.col("left") * stride})


def gap_fill(series: DataFrame, month: str, value: str, cloud: int) -> DataFrame:
    """Cloudy cells take the last clear value of earlier months, else stay."""
    w = Window.partitionBy(*CELL).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    clear = F.last(F.when(F.col(value) != cloud, F.col(value)), ignorenulls=True).over(w)
    return series.withColumn("filled", F.coalesce(clear, F.col(value)))
