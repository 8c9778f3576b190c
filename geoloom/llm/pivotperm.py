"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order and listed under each of them (inverted lists, one set for
each label). Two vectors of a list that share enough points are candidates, and their cosine decides. A pair that meets in
several lists counts in the list of the least point they share. Equal vectors are one class from the start, and a list
gives counts and a star for each of its connected parts, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .vectors import reference_points, usable

#: Members of a list that one task holds against as many others.
BLOCK = 2048
LINKS = "kind string, a long, b long"


def permutations(vectors: DataFrame, points: np.ndarray, prefix: int) -> DataFrame:
    """vectors (key, label, n, vector) with the indices of the prefix nearest points, nearest first; vectors of another length than theirs meet in one list for each length."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True) if len(points) else np.zeros((0, 0))

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = [np.argsort(-(unit @ np.asarray(v, float)), kind="stable")[:prefix].tolist() if len(v) == unit.shape[1] else [-len(v)] for v in frame["vector"]]
            yield frame.assign(points=near)

    return vectors.mapInPandas(described, "key long, label string, n long, vector array<double>, points array<int>")


def _members(points: pd.Series, names: np.ndarray) -> np.ndarray:
    place = {p: i for i, p in enumerate(names.tolist())}
    out = np.zeros((len(points), len(names)), np.float32)
    for i, ps in enumerate(points):
        out[i, [place[p] for p in ps]] = 1
    return out


def link_matrix(x: pd.DataFrame, y: pd.DataFrame, point: int, least: float, shared: int) -> np.ndarray:
    """Which rows of x and y link, of the pairs whose least shared point is this list's."""
    names = np.unique(np.concatenate([np.concatenate(list(x["points"])), np.concatenate(list(y["points"]))]))
    p, q = _members(x["points"], names), _members(y["points"], names)
    counts, before = p @ q.T, names < point
    enough = counts >= np.minimum(shared, np.minimum(p.sum(axis=1)[:, None], q.sum(axis=1)[None]))
    here = enough & (p[:, before] @ q[:, before].T == 0)
    u, v = np.stack(list(x["vector"])).astype(float), np.stack(list(y["vector"])).astype(float)
    return here & ((u @ v.T) / (np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]) >= least)


def stars(linked: np.ndarray) -> list[np.ndarray]:
    """The connected parts, of two or more, of a symmetric matrix; each row is looked at once."""
    left, parts = linked.any(axis=1), []
    while left.any():
        part = np.zeros(len(left), bool)
        edge = np.zeros(len(left), bool)
        edge[np.argmax(left)] = True
        while edge.any():
            part |= edge
            edge = linked[edge].any(axis=0) & ~part
        left &= ~part
        parts.append(np.flatnonzero(part))
    return parts


def sizes(largest: int, list_rows: int, prefix: int, most_points: int) -> tuple[int, int]:
    """The number of reference points for a label of so many vectors, and how many of the nearest describe a vector.

    Near vectors share fewer of their nearest points the more points there are: up to 256 points have prefix of them, and
    each doubling adds two.
    """
    wide = prefix
    while True:
        points = int(np.clip(largest * wide // list_rows, 32, most_points))
        if wide >= prefix + 2 * np.log2(max(points / 256, 1)):
            return points, wide
        wide += 1


def near_duplicates(vectors: DataFrame, least: float = 0.93, list_rows: int = 1024, prefix: int = 8, shared: int = 1, most_points: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, for vectors (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null; those that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. n_links counts the other vectors linked
    directly, component_id is the least vec_id reachable, itself included. Rows that repeat a vec_id are a vector each.
    The number of reference points follows the largest label, so that a list has about list_rows members, between 32 and
    most_points; longer lists are compared in blocks. Links that share fewer than `shared` points are missed; the prefix
    grows with the number of points (see sizes).
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    good = F.col("label").isNotNull() & usable(F.col("vector"))
    good = good & F.coalesce(F.when(good, norm > 0), F.lit(False))
    keyed = written(rows.select("vec_id", "label", "vector", F.when(good, F.xxhash64("label", "vector")).alias("key")), "vectors")
    found = keyed.where("key is not null")
    classes = found.groupBy("key").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count, prefix = sizes(largest, list_rows, prefix, most_points)
    points = reference_points(classes, "vector", count)
    index = written(permutations(classes.select("key", "label", "n", "vector"), points, prefix), "permutations")
    listed = index.withColumn("point", F.explode("points"))
    lengths = listed.groupBy("label", "point").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = listed.join(lengths, ["label", "point"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")))
    # Each block of a list meets every other: the pair of block numbers is part of the group's key.
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})

    def compared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, point, low, high = key
        group = group.sort_values("key", ignore_index=True)
        if low == high:
            linked = link_matrix(group, group, point, least, shared)
            np.fill_diagonal(linked, False)
        else:
            first = (group["block"] == low).to_numpy()
            linked = np.zeros((len(group), len(group)), bool)
            if first.any() and not first.all():
                linked[np.ix_(first, ~first)] = link_matrix(group[first], group[~first], point, least, shared)
                linked |= linked.T
        ids, sizes_ = group["key"].to_numpy(), group["n"].to_numpy()
        out = [("n", k, int(c)) for k, c in zip(ids.tolist(), (linked @ sizes_).tolist(), strict=True) if c]
        out += [("edge", ids[part[0]], ids[i]) for part in stars(linked) for i in part[1:]]
        return pd.DataFrame(out, columns=["kind", "a", "b"]).astype({"a": "int64", "b": "int64"})

    links = written(met.select("label", "point", "low", "high", "block", "key", "n", "vector", "points").groupBy("label", "point", "low", "high").applyInPandas(compared, LINKS), "links")
    joined = components(links.where("kind = 'edge'").select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = links.where("kind = 'n'").groupBy(F.col("a").alias("_a")).agg(F.sum("b").alias("_others"))
    owners = classes.select("key", "n").join(counts, F.col("key") == F.col("_a"), "left").join(joined, F.col("key") == F.col("node"), "left")
    owners = owners.select(F.col("key").alias("_key"), F.coalesce("component", "key").alias("_label"), (F.coalesce("_others", F.lit(0)) + F.col("n") - 1).alias("_links"))
    linked = keyed.select("vec_id", "key").join(owners, F.col("key") == F.col("_key"), "left")
    firsts = linked.where("_label is not null").groupBy(F.col("_label").alias("_group")).agg(F.min("vec_id").alias("_first"))
    ended = linked.join(firsts, F.col("_label") == F.col("_group"), "left")
    component = F.coalesce("_first", "vec_id")
    return ended.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
