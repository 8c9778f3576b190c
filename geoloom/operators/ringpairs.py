"""How small features lie to each other, for Arrow batches of pairs: what rings.relate says of them by joins of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FLAGS = ("contact", "l_in", "l_out", "r_in", "r_out", "same")

#: Pairs of edges that are looked at together.
_TOGETHER = 1 << 18


class _Edges:
    """The edges of a batch's features, one after the other, with their feature and part, and every part's first point."""

    def __init__(self, features: pa.Array):
        n_parts = pc.list_value_length(features).to_numpy(zero_copy_only=False)
        parts = features.flatten()
        n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        points = parts.flatten()
        x, y = (points.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        part = np.repeat(np.arange(len(n)), n)
        self.part_of = np.repeat(np.arange(len(n_parts)), n_parts)
        some = n > 0
        self.first, self.first_part = (np.cumsum(n) - n)[some], np.flatnonzero(some)
        self.px, self.py = x[self.first], y[self.first]
        at = np.flatnonzero(part[:-1] == part[1:])
        at = at[(x[at] != x[at + 1]) | (y[at] != y[at + 1])]
        self.x1, self.y1, self.x2, self.y2, self.part = x[at], y[at], x[at + 1], y[at + 1], part[at]
        self.row = self.part_of[self.part]
        self.n = np.bincount(self.row, minlength=len(n_parts))
        self.begin = np.cumsum(self.n) - self.n


def each(n: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For item i the numbers begin[i] .. begin[i] + n[i] - 1: which item, which number."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) + np.repeat(begin - (np.cumsum(n) - n), n)


def _side(e: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def _between(x: np.ndarray, y: np.ndarray, e: tuple) -> np.ndarray:
    return (x >= np.minimum(e[0], e[2])) & (x <= np.maximum(e[0], e[2])) & (y >= np.minimum(e[1], e[3])) & (y <= np.maximum(e[1], e[3]))


def _contacts(e: tuple, o: tuple) -> np.ndarray:
    """rings._contacts: up to four places along e, NaN where there are fewer."""
    dx, dy = e[2] - e[0], e[3] - e[1]
    first, last, a, b = _side(o, e[0], e[1]), _side(o, e[2], e[3]), _side(e, o[0], o[1]), _side(e, o[2], o[3])
    at = np.full((4, len(dx)), np.nan)
    at[0, (first == 0) & _between(e[0], e[1], o)] = 0.0
    at[1, (last == 0) & _between(e[2], e[3], o)] = 1.0
    for i, (s, x, y) in enumerate(((a, o[0], o[1]), (b, o[2], o[3])), 2):
        on = (s == 0) & _between(x, y, e)
        at[i, on] = (((x - e[0]) * dx + (y - e[1]) * dy)[on]) / (dx * dx + dy * dy)[on]
    proper = (np.sign(first) * np.sign(last) < 0) & (np.sign(a) * np.sign(b) < 0)
    at[:, proper] = np.nan
    at[0, proper] = first[proper] / (first - last)[proper]
    return at


def _inside(of: _Edges, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an odd number of the edges of row's feature lie right of the point."""
    p, e = each(of.n[row], of.begin[row])
    y1, y2, py = of.y1[e], of.y2[e], y[p]
    level = (y1 > py) != (y2 > py)
    p, e, y1, y2, py = p[level], e[level], y1[level], y2[level], py[level]
    right = x[p] < (of.x2[e] - of.x1[e]) * (py - y1) / (y2 - y1) + of.x1[e]
    return np.bincount(p[right], minlength=len(row)) % 2 == 1


def _pieces(own: _Edges, other: _Edges, edge: np.ndarray, at: np.ndarray, along: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the pieces of own's edges with contacts that don't run along other, and whether a piece lies inside."""
    kept = ~np.isnan(at)
    met = np.unique(edge)
    edges = np.concatenate([met, met, *[edge[k] for k in kept]])
    places = np.concatenate([np.zeros(len(met)), np.ones(len(met)), *[a[k] for a, k in zip(at, kept, strict=True)]])
    order = np.lexsort((places, edges))
    edges, places = edges[order], places[order]
    step = (edges[:-1] == edges[1:]) & (places[1:] - places[:-1] > near)
    e, t = edges[:-1][step], (places[:-1][step] + places[1:][step]) / 2
    if along.any():
        low, high, of = np.fmin.reduce(at[:, along]), np.fmax.reduce(at[:, along]), edge[along]
        order = np.argsort(of, kind="stable")
        low, high, of = low[order], high[order], of[order]
        begin = np.searchsorted(of, e)
        piece, on = each(np.searchsorted(of, e, side="right") - begin, begin)
        free = np.bincount(piece[(low[on] <= t[piece]) & (high[on] >= t[piece])], minlength=len(e)) == 0
        e, t = e[free], t[free]
    x, y = own.x1[e] + t * (own.x2[e] - own.x1[e]), own.y1[e] + t * (own.y2[e] - own.y1[e])
    return own.row[e], _inside(other, own.row[e], x, y)


def related(left: pa.Array, right: pa.Array, near: float, lines: bool) -> pa.Array:
    """FLAGS of each pair of features."""
    n = [pc.list_value_length(f.flatten()) for f in (left, right)]
    sums = [np.bincount(np.repeat(np.arange(len(f)), pc.list_value_length(f).to_numpy(zero_copy_only=False)), weights=k.to_numpy(zero_copy_only=False), minlength=len(f)) for f, k in zip((left, right), n, strict=True)]
    turn = np.cumsum(sums[0] * sums[1]) // _TOGETHER
    begins = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(left)]
    parts = [_related(left.slice(a, b - a), right.slice(a, b - a), near, lines) for a, b in zip(begins[:-1], begins[1:], strict=True) if b > a]
    flags = np.concatenate(parts, axis=1) if parts else np.zeros((len(FLAGS), 0), bool)
    return pa.StructArray.from_arrays([pa.array(f) for f in flags], names=list(FLAGS))


def _related(left: pa.Array, right: pa.Array, near: float, lines: bool) -> np.ndarray:
    l, r = _Edges(left), _Edges(right)
    flags = dict(zip(FLAGS, np.zeros((len(FLAGS), len(left)), bool), strict=True))
    a, b = each(r.n[l.row], r.begin[l.row])
    corners = lambda s, i: (s.x1[i], s.y1[i], s.x2[i], s.y2[i])
    e, o = corners(l, a), corners(r, b)
    close = (np.minimum(e[0], e[2]) <= np.maximum(o[0], o[2])) & (np.minimum(o[0], o[2]) <= np.maximum(e[0], e[2])) & (np.minimum(e[1], e[3]) <= np.maximum(o[1], o[3])) & (np.minimum(o[1], o[3]) <= np.maximum(e[1], e[3]))
    a, b = a[close], b[close]
    e, o = corners(l, a), corners(r, b)
    cl = _contacts(e, o)
    met = ~np.isnan(cl).all(axis=0)
    a, b, cl, e, o = a[met], b[met], cl[:, met], tuple(v[met] for v in e), tuple(v[met] for v in o)
    cr = _contacts(o, e)
    wide = lambda c: np.fmax.reduce(c) - np.fmin.reduce(c) > near
    along = wide(cl) & wide(cr)
    flags["contact"][l.row[a]] = True
    flags["same"][l.row[a[along & ((e[2] - e[0]) * (o[2] - o[0]) + (e[3] - e[1]) * (o[3] - o[1]) > 0)]]] = True
    for own, other, edge, at, name in ((l, r, a, cl, "l"), (r, l, b, cr, "r")):
        if name == "r" and lines:
            flags["r_out"][:] = True
            break
        # A part without a contact is told by one point, others by the pieces between their contacts.
        alone = ~np.isin(own.first_part, own.part[edge])
        row = own.part_of[own.first_part[alone]]
        for rows, held in (_pieces(own, other, edge, at, along, near), (row, _inside(other, row, own.px[alone], own.py[alone]))):
            flags[f"{name}_in"][rows[held]] = True
            flags[f"{name}_out"][rows[~held]] = True
    return np.array([flags[f] for f in FLAGS])
