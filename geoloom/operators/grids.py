"""Rasters onto other grids, and focal extrema of any size, by tiles as arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detections import by_halo
from .raster import kernel


@dataclass(frozen=True)
class Grid:
    """x = x0 + c * dx + r * rx and y = y0 + r * dy + c * ry at the upper left corner of cell (r, c), as a geotransform (x0, dx, rx, y0, ry, dy)."""

    x0: float
    dx: float
    y0: float
    dy: float
    rx: float = 0.0
    ry: float = 0.0

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        r, c = r + 0.5, c + 0.5
        return self.x0 + c * self.dx + r * self.rx, self.y0 + c * self.ry + r * self.dy

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column, counted from the centre of cell (0, 0), of a point."""
        whole = self.dx * self.dy - self.rx * self.ry
        if not whole:
            raise ValueError("the grid's cells have no area")
        if not self.rx and not self.ry:
            return (y - self.y0) / self.dy - 0.5, (x - self.x0) / self.dx - 0.5
        c = ((x - self.x0) * self.dy - (y - self.y0) * self.rx) / whole
        r = ((y - self.y0) * self.dx - (x - self.x0) * self.ry) / whole
        return r - 0.5, c - 0.5

    def cells(self, spark, rows: int, columns: int) -> DataFrame:
        """r, c of a grid of so many rows and columns; a row of cells is made at a time."""
        at = spark.range(rows).select(F.col("id").cast("int").alias("r"))
        return at.select("r", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))


def _gathered(method: str, value: str, size: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def solve(key: tuple, wanted: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size + 1, size + 1), np.nan)  # one more row and column than the tile
        grid[source["r"].to_numpy() - key[-2] * size, source["c"].to_numpy() - key[-1] * size] = source[value]
        y, x = wanted["sr"].to_numpy() - key[-2] * size, wanted["sc"].to_numpy() - key[-1] * size
        top, left = np.floor(y).astype(int), np.floor(x).astype(int)
        if method == "nearest":
            found = grid[top, left]
        else:
            total, weights = np.zeros(len(y)), np.zeros(len(y))
            for down in (0, 1):
                for right in (0, 1):
                    v = grid[top + down, left + right]
                    w = np.where(np.isnan(v), 0.0, (1 - np.abs(y - top - down)) * (1 - np.abs(x - left - right)))
                    total += np.where(w > 0, np.nan_to_num(v) * w, 0.0)
                    weights += w
            found = np.divide(total, weights, out=np.full(len(y), np.nan), where=weights > 0)
        held = ~np.isnan(found)
        out = wanted.loc[held, [c for c in wanted.columns if c not in ("sr", "sc", "tr", "tc")]]
        return out.assign(**{value: found[held]})

    return solve


def align(source: DataFrame, grid: Grid, target: DataFrame, onto: Grid, value: str, method: str = "bilinear", nodata: float | None = None, by: Sequence[str] = (), size: int = 256) -> DataFrame:
    """by, r, c, value: source (by, r, c, value on grid) resampled at the centres of target's cells (r, c on onto).

    bilinear: the four source cells around the centre, by distance; those without data don't count, and a cell none of whose four has
    data is left out. nearest: the cell that holds the centre (its lower edges count). A target cell goes to one tile, that of
    its upper left source cell; a source cell goes to its tile and, on the upper or left rim of one, to those that need it as their
    last row or column, so that about one row is shuffled for each cell of either side. by: bands or scenes, all onto every target cell.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"method is bilinear or nearest, not {method}")
    by = list(by)
    data = source.select(*by, "r", "c", F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    if nodata is not None:
        data = data.where(F.col(value) != nodata)
    sr, sc = grid.place(*onto.centre(F.col("r"), F.col("c")))
    if method == "nearest":
        sr, sc = F.floor(sr + 0.5), F.floor(sc + 0.5)
    tile = lambda v: F.floor(v / size).cast("int")
    wanted = target.select("r", "c", sr.cast("double").alias("sr"), sc.cast("double").alias("sc")).withColumns({"tr": tile(F.floor("sr")), "tc": tile(F.floor("sc"))})
    if by:  # tiles of the target know no scene: each meets those that have cells there
        beside = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c))).alias(c)
        held = data.select(*[F.col(k).alias(k) for k in by], tile(F.col("r")).alias("tr"), tile(F.col("c")).alias("tc")).distinct()
        held = held.select(*by, beside("tr"), "tc").select(*by, "tr", beside("tc")).distinct()
        wanted = wanted.join(held, ["tr", "tc"])
    reach = lambda c: F.explode(F.sequence(tile(F.col(c) - 1), tile(F.col(c))))
    dealt = data.withColumn("tr", reach("r")).withColumn("tc", reach("c"))
    types = "".join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in by)
    keys = [*by, "tr", "tc"]
    wanted = wanted.select(*[F.col(k).alias(k) for k in keys], "r", "c", "sr", "sc")
    return wanted.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_shaped(_gathered(method, value, size), by), f"{types}r int, c int, {value} double")


def _shaped(solve: Callable, by: Sequence[str]) -> Callable:
    def f(key: tuple, wanted: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        return solve(key, wanted, source)[[*by, "r", "c", *[c for c in source.columns if c not in (*by, "r", "c", "tr", "tc")]]]

    return f


# -- focal extrema


def _running_max(a: np.ndarray, width: int) -> np.ndarray:
    """The greatest of every width values in a row, along the last axis: maxima of runs of 1, 2, 4, ... values, then of two that overlap."""
    done, out = 1, a
    while 2 * done <= width:
        out = np.maximum(out[..., : out.shape[-1] - done], out[..., done:])
        done *= 2
    rest = width - done
    return np.maximum(out[..., : out.shape[-1] - rest], out[..., rest:]) if rest else out


def _dilated(tile: np.ndarray, rows: Sequence[tuple[int, int]], half: int) -> np.ndarray:
    """The greatest value under the kernel around each cell at least half from the rim. rows: (dy, half width) of the kernel's rows."""
    n = tile.shape[0] - 2 * half
    if all(w == half for _, w in rows):  # a rectangle: along rows, then along columns
        return _running_max(_running_max(tile, 2 * half + 1).T, 2 * half + 1).T
    out = np.full((n, n), -np.inf)
    for dy, w in rows:
        line = tile[half + dy : half + dy + n, half - w : half + n + w]
        np.maximum(out, _running_max(line, 2 * w + 1), out=out)
    return out


def focal(mask: DataFrame, op: str, size: int, shape: str = "rect", iterations: int = 1, value: str = "cls", tile: int = 256) -> DataFrame:
    """r, c, value: the greatest (dilate) or least (erode) value under a kernel of odd size around each cell of mask, or open, close, gradient of both.

    Cells that mask lacks count for nothing and stay out, as in raster.dilate. Tiles are arrays with a rim as wide as all
    iterations reach; a rectangle takes two passes of running extrema, other shapes one for each of the kernel's rows, so neither
    rows shuffled nor steps follow the kernel's area. With a rim of at most a sixth of the tile, under two rows a cell are shuffled.
    """
    steps = {"dilate": (1,), "erode": (-1,), "open": (-1, 1), "close": (1, -1), "gradient": (1,)}
    if op not in steps or size < 1 or size % 2 == 0 or iterations < 1:
        raise ValueError("op is dilate, erode, open, close or gradient; size is odd; iterations 1 or more")
    half = size // 2
    offsets = kernel(size, shape)
    rows = sorted({(y, max(x for v, x in offsets if v == y)) for y, _ in offsets})
    passes = [s for s in steps[op] for _ in range(iterations)]

    def run(grid: np.ndarray, signs: Sequence[int]) -> np.ndarray:
        for sign in signs:
            there = ~np.isnan(grid)
            near = _dilated(np.where(there, sign * grid, -np.inf), rows, half)
            inner = there[half : len(grid) - half, half : len(grid) - half]
            grid = np.where(inner, sign * near, np.nan)
        return grid

    def f(grid: np.ndarray) -> np.ndarray:
        return run(grid, passes) - run(grid, [-s for s in passes]) if op == "gradient" else run(grid, passes)

    rim = half * len(passes)
    found = by_halo(mask, max(tile, 6 * rim), rim, f, value, "_v") if rim else mask.select("r", "c", (F.col(value) * (0 if op == "gradient" else 1)).alias("_v"))
    return found.select("r", "c", F.col("_v").cast(mask.schema[value].dataType).alias(value))
