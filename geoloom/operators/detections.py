"""Greedy suppression of boxes, region labels, and windows with a halo."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..scratch import written
from . import spatial


#: Boxes of the first lots. A lot with fewer overlaps a box than _CROWDED is followed by one of twice as many.
_AT_ONCE, _CROWDED = 10_000, 8

#: Overlaps of a lot that a task settles, as 24 bytes each; more take rounds of joins (a lot in one image had 1.2 million at 60 x sf0.1).
_SETTLED = 3_000_000


def suppress(boxes: DataFrame, by: Sequence[str], most: float, size: float = 64) -> DataFrame:
    """The boxes (id, sides, score, by) that no kept box of higher score (then lesser id) of their group overlaps by more than most.

    Many boxes are worked on from the best scores on, lot by lot: a lot is decided, then all that its kept boxes suppress
    go. So boxes meet kept ones and those of their own lot only, not all others. Lots stay small where boxes crowd, since
    their overlaps grow with the square of a lot, and each takes a share of all that are left; elsewhere they double.
    Boxes without a score neither suppress nor go.
    """
    columns = list(dict.fromkeys(["id", *by, *spatial.SIDES, "score"]))
    left = written(spatial.dealt(boxes.where("score is not null").select(*columns), "id"), "boxes")
    kept, lot = [boxes.where("score is null").select("id")], _AT_ONCE
    while n := left.count():
        cut = left.agg(F.percentile_approx("score", 1 - lot / n, 10_000)).first()[0] if n > lot else None  # one number
        head = left if cut is None else left.where(F.col("score") >= cut)
        over = _overlaps(head, by, most, size)
        met = over.count()
        good = written(head.join(_decided(head, over, met), "id", "left_semi"), "kept")
        kept.append(good.select("id"))
        if cut is None:
            break
        tail = left.where(F.col("score") < cut)
        gone = spatial.box_pairs(good, tail, size, by=by, few=good.count() <= _AT_ONCE).where(_over(most)).select("r.id").distinct()
        left = written(tail.join(gone, "id", "left_anti"), "boxes")
        lot = lot if met > _CROWDED * lot else 2 * lot
    return boxes.join(reduce(DataFrame.union, kept), "id", "left_semi")


def _over(most: float) -> Column:
    sides = lambda s: tuple(F.col(f"{s}.{x}") for x in spatial.SIDES)
    return iou(sides("l"), sides("r")) > most


def _overlaps(boxes: DataFrame, by: Sequence[str], most: float, size: float) -> DataFrame:
    """better, worse, score, lot: the ids of boxes that overlap by more than most, the score of the worse, and 0."""
    better = (F.col("l.score") > F.col("r.score")) | ((F.col("l.score") == F.col("r.score")) & (F.col("l.id") < F.col("r.id")))
    over = spatial.box_pairs(boxes, boxes, size, by=by).where(better & _over(most))
    return written(over.select(F.col("l.id").alias("better"), F.col("r.id").alias("worse"), F.col("r.score").alias("score"), F.lit(0).alias("lot")), "overlaps")


def _settled(over: pd.DataFrame) -> pd.DataFrame:
    """The ids that go, of one lot's overlaps: from the best score on, a box goes if a better one that it overlaps has stayed."""
    order = np.lexsort((over["worse"], -over["score"].to_numpy(float)))
    ids, at = np.unique(np.concatenate([over["worse"], over["better"]]), return_inverse=True)
    worse, better = at[: len(over)][order], at[len(over) :][order]
    gone = bytearray(len(ids))
    for i in range(0, len(order), 1 << 16):  # numbers of Python take ten times the room
        for w, b in zip(worse[i : i + (1 << 16)].tolist(), better[i : i + (1 << 16)].tolist(), strict=True):
            if not gone[b]:
                gone[w] = 1
    return pd.DataFrame({"id": ids[np.frombuffer(gone, bool)]})


def _decided(boxes: DataFrame, over: DataFrame, met: int) -> DataFrame:
    """The ids that suppress keeps of one lot with met overlaps over. Few of them are settled in a task.

    More: greedy order without a global one: in each round a box with no undecided better overlapping box is kept, and what it
    suppresses goes; rounds go on until all are decided, and their number is the longest chain of overlaps. Each round is
    joins and aggregates over the overlapping pairs only.
    """
    if met <= _SETTLED:
        return boxes.select("id").join(over.groupBy("lot").applyInPandas(_settled, boxes.select("id").schema), "id", "left_anti")
    state = written(boxes.select("id", F.lit(None).cast("boolean").alias("kept")), "boxes")
    while True:
        good = F.col("better_kept")
        seen = over.select("better", "worse").join(state.select(F.col("id").alias("better"), F.col("kept").alias("better_kept")), "better").groupBy(F.col("worse").alias("id")).agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~good, F.lit(False))).alias("free"))
        new = state.join(seen, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("free", F.lit(True)), True).alias("kept"))
        state = written(new, "boxes")
        if state.where("kept is null").isEmpty():
            return state.where("kept").select("id")


def median_around(halo: int) -> Callable[[np.ndarray], np.ndarray]:
    """The median of the (2 * halo + 1) square around each inner cell of a padded tile; cells that are missing (NaN) don't count."""

    def f(tile: np.ndarray) -> np.ndarray:
        around = np.lib.stride_tricks.sliding_window_view(tile, (2 * halo + 1,) * 2)
        flat = np.sort(around.reshape(*around.shape[:2], -1), axis=-1)  # NaN last
        n = np.maximum((~np.isnan(flat)).sum(axis=-1), 1)
        at = lambda i: np.take_along_axis(flat, i[..., None], axis=-1)[..., 0]
        return (at((n - 1) // 2) + at(n // 2)) / 2

    return f


def by_halo(mask: DataFrame, size: int, halo: int, f: Callable[[np.ndarray], np.ndarray], value: str = "cls", out: str = "result") -> DataFrame:
    """r, c, out: a caller's function of tiles with a rim of halo cells of their neighbours (NaN where there are none).

    f takes a square of size + 2 * halo cells and gives the size * size values within the rim. A cell is sent to every tile
    whose rim it lies in; each tile is one array, and only its own cells are written back.
    """
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    dealt = mask.select("r", "c", value, reach("r").alias("tr")).select("*", reach("c").alias("tc"))

    def solve(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        top, left = key[0] * size - halo, key[1] * size - halo
        grid = np.full((size + 2 * halo,) * 2, np.nan)
        r, c = tile["r"].to_numpy() - top, tile["c"].to_numpy() - left
        grid[r, c] = tile[value]
        own = (r >= halo) & (r < halo + size) & (c >= halo) & (c < halo + size)
        if not own.any():
            return pd.DataFrame({"r": [], "c": [], out: []}).astype({"r": "int32", "c": "int32", out: "float64"})
        return pd.DataFrame({"r": r[own] + top, "c": c[own] + left, out: np.asarray(f(grid), float)[r[own] - halo, c[own] - halo]})

    return dealt.groupBy("tr", "tc").applyInPandas(solve, f"r int, c int, {out} double")


def _least_of_tile(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each cell, in order of (r, c), the first cell of its region: neighbours hook on to the least of both, then chains are cut short."""
    at = np.full((r.max() + 2, c.max() + 2), -1)
    at[r, c] = np.arange(len(r))
    a = np.tile(np.arange(len(r)), 2)
    b = np.concatenate([at[r + 1, c], at[r, c + 1]])
    same = (b >= 0) & (v[a] == v[b])
    a, b, root = a[same], b[same], np.arange(len(r))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != (short := root[root])).any():
            root = short
    return root


def regions(mask: DataFrame, value: str = "cls", tile: int = 64) -> DataFrame:
    """mask (r, c, value) with region: equal neighbours (left, right, up, down) share one, named by its least cell r << 32 | c.

    Tiles are labelled by themselves; only the labels that meet across tile borders become edges, which are joined by
    taking the least label of neighbours until nothing changes.
    """

    def label(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["r", "c"], ignore_index=True)
        r, c, v = (cells[x].to_numpy() for x in ("r", "c", value))
        root = _least_of_tile(r - r.min(), c - c.min(), v)
        return pd.DataFrame({"r": r, "c": c, value: v, "local": r[root].astype("int64") << 32 | c[root]})

    tiled = mask.select("r", "c", value).withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    cells = written(tiled.groupBy("tr", "tc").applyInPandas(label, f"r int, c int, {value} int, local long"), "labels")
    border = cells.where(" or ".join(f"pmod({x}, {tile}) in (0, {tile - 1})" for x in "rc"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.lit(0).alias("x")), F.struct(F.lit(0).alias("y"), F.lit(1).alias("x"))))
    ahead = border.select((F.col("r")).alias("r"), "c", value, "local", step.alias("s")).select((F.col("r") + F.col("s.y")).alias("r"), (F.col("c") + F.col("s.x")).alias("c"), value, F.col("local").alias("other"))
    edges = ahead.join(border, ["r", "c", value]).where("local <> other").select(F.least("local", "other").alias("u"), F.greatest("local", "other").alias("v")).distinct()
    names = _least_labels(edges)
    return cells.join(names, F.col("local") == F.col("node"), "left").select("r", "c", value, F.coalesce("least", "local").alias("region"))


def _least_labels(edges: DataFrame) -> DataFrame:
    """node, least: the least node reachable over edges (u, v). Each round looks two steps ahead, so that long chains shorten fast."""
    both = written(edges.union(edges.select("v", "u")), "edges")
    state = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("least")), "names")
    while True:
        near = both.join(state, F.col("v") == F.col("node")).groupBy("u").agg(F.min("least").alias("m"))
        step = state.join(near, F.col("node") == F.col("u")).select("node", F.least("least", "m").alias("least"))
        jump = step.select(F.col("node").alias("j"), F.col("least").alias("m2"))
        new = written(step.join(jump, F.col("least") == F.col("j"), "left").select("node", F.least("least", F.coalesce("m2", "least")).alias("least")), "names")
        if new.join(state.withColumnRenamed("least", "old"), "node").where("least <> old").isEmpty():
            return new
        state = new

