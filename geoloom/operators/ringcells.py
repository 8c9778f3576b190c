"""Pairs of small features, told in the one task where both lie: what is said of a pair is a row, the pair's rings never are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, StructField, StructType

from . import ringpairs
from .spatial import SIDES, dealt

#: Left features of a cell that one part takes, pairs of bounds that are looked at together, and pairs of features.
_PART, _TOGETHER, _PAIRS = 16384, 1 << 18, 8192
#: Corners of a convex ring whose pairs are told by sides alone.
_CONVEX = 8
#: Cells of the coarsest level are so many doublings larger than the finest; a width is taken this much larger for rounding.
_COARSEST, _SLACK = 40, 1 + 1e-6
_KEYS = ["level", "gx", "gy", "part"]

Pairs = tuple[np.ndarray, np.ndarray]
#: Tells of pairs (left features, right features, their numbers in both): which pairs it keeps, and the columns said of these.
Told = Callable[["Features", np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]]


class Features:
    """The features of some rows: corners of all paths one after the other, bounds, and convex rings as corners of equal number."""

    def __init__(self, rows: pa.Table):
        one = {c: rows.column(c).combine_chunks() for c in ("xy", "n")}
        self.parts = pc.list_value_length(one["n"]).to_numpy(zero_copy_only=False)
        self.n = one["n"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        xy = one["xy"].flatten().to_numpy(zero_copy_only=False)
        self.x, self.y = np.ascontiguousarray(xy[0::2]), np.ascontiguousarray(xy[1::2])
        self.first = np.cumsum(self.n) - self.n
        self.first_part = np.cumsum(self.parts) - self.parts
        at = self.first[self.first_part]
        self.bounds = [f.reduceat(v, at) for f, v in ((np.minimum, self.x), (np.minimum, self.y), (np.maximum, self.x), (np.maximum, self.y))]
        self._nested = None

    def nested(self) -> pa.Array:
        """The features as arrays of paths of points."""
        if self._nested is None:
            points = pa.StructArray.from_arrays([pa.array(self.x), pa.array(self.y)], names=["x", "y"])
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            self._nested = pa.ListArray.from_arrays(ends(self.parts), pa.ListArray.from_arrays(ends(self.n), points))
        return self._nested

    def convex(self) -> None:
        """shells and holes: x, y of the corners of the first two paths, counter-clockwise, the first again at the end; plain: whether a feature is a strictly convex shell, or one with one such hole strictly within it (holed)."""
        self.holed = self.parts == 2
        open_n, few = self.n - 1, np.where(self.parts > 2, False, True)
        few &= np.logical_and.reduceat((open_n >= 3) & (open_n <= _CONVEX), self.first_part)
        most = int(open_n[np.repeat(few, self.parts)].max(initial=3))
        k = np.arange(most + 1)[:, None]
        corners = []
        for part, turn in ((self.first_part, 1), (np.where(self.holed, self.first_part + 1, self.first_part), -1)):
            n = np.maximum(open_n[part], 1)
            sign = np.where(self.holed, turn, 1)
            at = self.first[part] + np.where(few, (sign * k) % n, 0)
            x, y = self.x[at], self.y[at]
            for i in range(most):
                side = _sides(x, y, i, x[:most], y[:most])
                ends = (k[:most] % n == i % n) | (k[:most] % n == (i + 1) % n)
                few &= ((side > 0) | ends).all(axis=0)
            corners.append((x, y))
        self.shells, self.holes = corners
        self.corners = np.where(few, np.maximum.reduceat(open_n, self.first_part), 0)
        for i in range(most) if self.holed.any() else ():
            within = _sides(*self.shells, i, self.holes[0][:most], self.holes[1][:most]) > 0
            few &= within.all(axis=0) | ~self.holed
        self.plain = few
        self.all_plain, self.any_holed = bool(few.all()), bool(self.holed.any())


def _sides(x: np.ndarray, y: np.ndarray, edge: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Above 0 where corners (a row each) lie left of each ring's edge, 0 on its line."""
    a = py - y[edge]
    a *= x[edge + 1] - x[edge]
    b = px - x[edge]
    b *= y[edge + 1] - y[edge]
    a -= b
    return a


def _of(corners: Pairs, at: np.ndarray, most: int) -> Pairs:
    """x, y of the rings of most corners at most, closed."""
    return np.take(corners[0][: most + 1], at, axis=1), np.take(corners[1][: most + 1], at, axis=1)


def _apart(l: Pairs, r: Pairs, least: float = 0.0) -> np.ndarray:
    """Which pairs of convex rings share no point: all corners of one lie beyond an edge of the other (its far side below least)."""
    apart = np.zeros(l[0].shape[1], bool)
    for own, other in ((l, r), (r, l)):
        x, y = other[0][:-1], other[1][:-1]
        for k in range(len(own[0]) - 1):
            apart |= _sides(*own, k, x, y).max(axis=0) < least
    return apart


def _all_apart(f: Features, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
    """_apart for the shells of pairs of plain features."""
    most = [int(f.corners[v].max(initial=3)) for v in (i, j)]
    cut = lambda v, n, at: _of(f.shells, v[at : at + _PAIRS], n)
    return np.concatenate([np.zeros(0, bool), *[_apart(cut(i, most[0], at), cut(j, most[1], at), least) for at in range(0, len(i), _PAIRS)]])


def beside(f: Features, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of plain features share no area (a tiny side counts as none, so that rings that touch are beside each other)."""
    return _all_apart(f, i, j, np.finfo(float).tiny)


def _told_by_sides(l: Pairs, r: Pairs) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """ringpairs.FLAGS of pairs of convex rings, and which pairs have edges on one line and so aren't told by this.

    Convex rings are apart if and only if all corners of one lie beyond an edge of the other; where their insides meet, a
    part of one's boundary lies inside the other if the other has corners outside the one.
    """
    n = l[0].shape[1]
    apart, beside, along = np.zeros((3, n), bool)
    outside, within = [], []
    for own, other in ((l, r), (r, l)):
        x, y = other[0][:-1], other[1][:-1]
        lowest, on_line = None, np.zeros(n, bool)
        for k in range(len(own[0]) - 1):
            side = _sides(*own, k, x, y)
            high, low = side.max(axis=0), side.min(axis=0)
            apart |= high < 0
            beside |= high <= 0
            on_line |= (high == 0) | (low == 0)
            lowest = low if lowest is None else np.minimum(lowest, low, out=lowest)
        outside.append(lowest < 0)
        within.append(lowest > 0)
        at = np.flatnonzero(on_line & ~apart)
        if len(at):
            own, other = (tuple(v[:, at] for v in of) for of in (own, other))
            for k in range(len(own[0]) - 1):
                zero = _sides(*own, k, *other) == 0
                along[at] |= (zero[1:] & zero[:-1]).any(axis=0)
    inner, shared = ~beside, ~apart
    r_out, l_out = outside
    flags = {"contact": shared & ~within[0] & ~within[1], "l_in": inner & r_out, "l_out": l_out, "r_in": inner & l_out, "r_out": r_out, "same": np.zeros(n, bool)}
    return flags, along & shared


def _plain(f: Features, i: np.ndarray, j: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """_told_by_sides for shells of which one of a pair may have a hole."""
    most = [int(f.corners[v].max(initial=3)) for v in (i, j)]
    l, r = _of(f.shells, i, most[0]), _of(f.shells, j, most[1])
    flags, along = _told_by_sides(l, r)
    for own, other, holed in (("l", "r", f.holed[j]), ("r", "l", f.holed[i])) if f.any_holed else ():
        s = np.flatnonzero(holed & (flags["contact"] | flags["l_in"] | flags["r_in"]))  # to others a hole adds nothing
        if len(s):
            sides = [(_of(f.holes, v[s], n) if one == other else tuple(c[:, s] for c in shell)) for one, v, n, shell in zip("lr", (i, j), most, (l, r), strict=True)]
            of_hole, hole_along = _told_by_sides(*sides)
            # A boundary that is partly within the shell is within the feature too unless all of it lies in the hole.
            flags[f"{own}_in"][s] &= of_hole[f"{own}_out"]
            flags[f"{own}_out"][s] |= of_hole[f"{own}_in"]
            for name in (f"{other}_in", f"{other}_out", "contact"):
                flags[name][s] |= of_hole[name]
            along[s] |= hole_along
    return flags, along


def related(near: float, lines: bool, kept: Callable[[dict[str, np.ndarray]], np.ndarray] | None, with_flags: bool, touching: bool = False) -> Told:
    """Flags of ringpairs for all pairs, or those that kept takes by their flags. touching: kept takes all that share a point."""

    def plain_ones(f: Features, i: np.ndarray, j: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        parts = [_plain(f, i[at : at + _PAIRS], j[at : at + _PAIRS]) for at in range(0, len(i), _PAIRS)]
        return {n: np.concatenate([p[0][n] for p in parts]) for n in ringpairs.FLAGS}, np.concatenate([p[1] for p in parts])

    def told(f: Features, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        if lines:
            flags, rest = {n: np.zeros(len(i), bool) for n in ringpairs.FLAGS}, np.arange(len(i))
        elif f.all_plain and not f.any_holed and touching and not with_flags:
            return np.flatnonzero(~_all_apart(f, i, j)), []
        elif f.all_plain and not (f.any_holed and (f.holed[i] & f.holed[j]).any()):
            flags, along = plain_ones(f, i, j)
            rest = np.flatnonzero(along)
        else:
            flags, rest = {n: np.zeros(len(i), bool) for n in ringpairs.FLAGS}, np.ones(len(i), bool)
            plain = np.flatnonzero(f.plain[i] & f.plain[j] & ~(f.holed[i] & f.holed[j]))
            if len(plain):
                found, along = plain_ones(f, i[plain], j[plain])
                for n in flags:
                    flags[n][plain] = found[n]
                rest[plain] = along
            rest = np.flatnonzero(rest)
        if len(rest):
            found = ringpairs.related(f.nested().take(pa.array(i[rest])), f.nested().take(pa.array(j[rest])), near, lines)
            for n in flags:
                flags[n][rest] = found.field(n).to_numpy(zero_copy_only=False)
        which = np.flatnonzero(kept(flags)) if kept else np.arange(len(i))
        return which, [pa.array(flags[n][which]) for n in ringpairs.FLAGS] if with_flags else []

    return told


def pairs(left: DataFrame, right: DataFrame, size: float, told: Told, columns: list[tuple[str, DataType]], by_sides: bool = True, bounds: str = "touch") -> DataFrame:
    """l, r (the keys) and columns: what told says of each two features whose bounds touch (or overlap, or those of left contain, or are within, those of right) and that it keeps.

    left and right: key, paths (an array of paths; keys may be of any type) and their bounds. A left feature lies in one cell, that of its
    lower left corner, on the level (size doubled as often as needed) that is as long as it, and on the coarser levels of right features;
    right ones go to all cells whose left features can reach them. A pair meets on the coarser of both own levels. A cell with very
    many left features is dealt out in parts; a task holds the right features that are near one cell.
    """
    longest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).cast("double")
    mine = F.when(longest > size, F.least(F.ceil(F.log2(longest / size)), F.lit(_COARSEST))).otherwise(0).cast("int")
    levels = [sorted(r["mine"] for r in d.select(mine.alias("mine")).distinct().collect() if r["mine"] is not None) for d in (left, right)]  # _COARSEST + 1 numbers at most
    wide = size * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda v: F.floor(v / (wide / 2)).cast("long")
    corners = F.flatten(F.transform(F.flatten("paths"), lambda p: F.array(p["x"], p["y"])))

    def placed(layer: DataFrame, others: list[int]) -> DataFrame:
        coarser = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("mine"))
        flat = layer.select("key", corners.alias("xy"), F.transform("paths", lambda p: F.size(p)).alias("n"), *SIDES).withColumn("mine", mine)
        return dealt(flat, "key").withColumn("level", F.explode(F.concat(F.array("mine"), coarser)))

    boxes = placed(left, levels[1]).withColumns({"gx": cell(F.col("xmin")), "gy": cell(F.col("ymin"))})
    parts = boxes.groupBy(*_KEYS[:3]).agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts"))
    near = placed(right, levels[0])
    for g, low, high in (("gx", "xmin", "xmax"), ("gy", "ymin", "ymax")):
        near = near.withColumn(g, F.explode(F.sequence(cell(F.col(low) - wide * _SLACK), cell(F.col(high)))))
    key = lambda d, own: F.col("key") if own else F.lit(None).cast(d.schema["key"].dataType)
    told_of = lambda own: [*_KEYS, F.lit(own).alias("own"), "mine", key(left, own == 1).alias("l"), key(right, own == 0).alias("r"), "xy", "n"]
    near = dealt(near, *_KEYS[:3]).hint("merge").join(parts, _KEYS[:3]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("xy"), F.col("parts")).cast("int")
    rows = near.select(*told_of(0)).unionByName(boxes.join(parts, _KEYS[:3]).withColumn("part", part).select(*told_of(1)))
    ordered = dealt(rows, *_KEYS).sortWithinPartitions(*_KEYS, "own")
    schema = StructType([StructField("l", left.schema["key"].dataType), StructField("r", right.schema["key"].dataType), *[StructField(c, t) for c, t in columns]])
    return ordered.mapInArrow(_found(told, schema.names, by_sides, bounds), schema)


def _found(told: Told, names: list[str], by_sides: bool, bounds: str):
    """Rows in order of (level, gx, gy, part, own): a group's right features (own 0), then its left ones (own 1)."""

    def met(rows: pa.Table, f: Features) -> Iterator[Pairs]:
        """Numbers of left and right features whose bounds meet, some at a time."""
        keys = np.stack([np.asarray(rows.column(c)) for c in _KEYS])
        own, mine, level = np.asarray(rows.column("own")), np.asarray(rows.column("mine")), keys[0]
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        less = np.less if bounds == "overlap" else np.less_equal
        held, size = [], 0
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
            m = a + int(np.searchsorted(own[a:b], 1))
            if m == a or m == b:
                continue
            low_x, low_y, high_x, high_y = (v[a:m] for v in f.bounds)
            mixed = (mine[a:b] != level[a]).any() and (mine[m:b] != level[a]).any()
            step = max(1, _TOGETHER // (m - a))
            for at in range(m, b, step):
                cut = slice(at, min(at + step, b))
                x0, y0, x1, y1 = (v[cut, None] for v in f.bounds)
                if bounds == "contain":
                    smaller = ((x0, low_x), (high_x, x1), (y0, low_y), (high_y, y1))
                elif bounds == "within":
                    smaller = ((low_x, x0), (x1, high_x), (low_y, y0), (y1, high_y))
                else:
                    smaller = ((low_x, x1), (x0, high_x), (low_y, y1), (y0, high_y))
                near = less(*smaller[0])
                for two in smaller[1:]:
                    near &= less(*two)
                if mixed:
                    near &= (mine[cut, None] == level[a]) | (mine[a:m] == level[a])
                both = np.flatnonzero(near)
                i = both // (m - a)
                j = both - i * (m - a)
                if len(i):
                    held.append((i + at, j + a))
                    size += len(i)
                if size >= _TOGETHER // 4:
                    yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))

    def said(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        f = Features(rows)
        if by_sides:
            f.convex()
        l, r = (rows.column(c).combine_chunks() for c in ("l", "r"))
        for i, j in met(rows, f):
            which, columns = told(f, i, j)
            if len(which):
                yield pa.RecordBatch.from_arrays([l.take(pa.array(i[which])), r.take(pa.array(j[which])), *columns], names=names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = np.stack([np.asarray(batch.column(c)) for c in _KEYS]), np.asarray(batch.column("own"))
            if own.any():
                yield from said(pa.Table.from_batches([*held, batch]).combine_chunks())
            last = keys[:, -1]
            if group is None or (last != group).any():
                held, group = [], last
            tail = np.flatnonzero((keys == last[:, None]).all(axis=0) & (own == 0))
            if len(tail):
                held.append(batch.slice(tail[0], len(tail)))

    return found


FLAG_COLUMNS = [(f, BooleanType()) for f in ringpairs.FLAGS]
AREA_COLUMNS = [("area", DoubleType())]
