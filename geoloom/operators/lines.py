"""Lines and rings with fewer points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a path stay: both ends, and of every stretch whose farthest point lies more than tolerance from the segment of its ends, that point.

    Stretches wait on a stack, so that a long path needs no deep recursion.
    """
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square > 0 else np.zeros(b - a - 1)
        far = (px - t * dx) ** 2 + (py - t * dy) ** 2
        at = int(far.argmax())
        if far[at] > tolerance * tolerance:
            at += a + 1
            keep[at] = True
            todo += [(a, at), (at, b)]
    return keep


def simplified(path: Column, tolerance: float) -> Column:
    """A path (array of x, y) by farthest-point splitting: no dropped point lies more than tolerance from the line that stays, and both ends stay.

    A ring that would have fewer than four points left keeps them all, so that it stays a ring. Null stays null. Many
    paths of a batch are worked on from one pair of packed arrays.
    """

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def solve(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or len(x) < 3:
                out.append(None if x is None else list(zip(x, y, strict=True)))
                continue
            keep = keep_points(np.asarray(x), np.asarray(y), tolerance)
            if (x[0], y[0]) == (x[-1], y[-1]) and keep.sum() < 4:
                keep[:] = True
            out.append(list(zip(np.asarray(x)[keep].tolist(), np.asarray(y)[keep].tolist(), strict=True)))
        return pd.Series(out, dtype=object)

    return solve(F.transform(path, lambda p: p["x"].cast("double")), F.transform(path, lambda p: p["y"].cast("double")))
