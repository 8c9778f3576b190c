"""Labels along a hierarchy whose nodes may have several parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def closure(edges: DataFrame) -> DataFrame:
    """node, ancestor: all pairs joined by a path of edges (child, parent); a node isn't its own ancestor. A cycle is an error.

    Paths are joined end to end, so that each round doubles their length, until none is new; edges that repeat count once.
    """
    paths = written(edges.where("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "paths")
    while True:
        if not paths.where("node = ancestor").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        on = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"))
        new = paths.join(on, "ancestor").select("node", F.col("_next").alias("ancestor")).distinct().join(paths, ["node", "ancestor"], "left_anti")
        new = written(new, "paths")
        if new.isEmpty():
            return paths
        paths = written(paths.union(new), "paths")


def expand(labels: DataFrame, edges: DataFrame, label: str, positive: str | None = None) -> DataFrame:
    """labels, and a copy of each row for every ancestor of its label; with positive (a boolean column), rows where it is false for every descendant instead.

    All other columns go along; labels that the hierarchy lacks stay as they are.
    """
    pairs = closure(edges)
    up, down = pairs.select(F.col("node").alias("_from"), F.col("ancestor").alias("_to")), pairs.select(F.col("ancestor").alias("_from"), F.col("node").alias("_to"))
    # A row travels as one struct, so that its column names meet no others.
    packed = lambda rows: rows.select(F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("_row"))
    copied = lambda rows, way: packed(rows).join(way, F.col(f"_row.`{label}`") == F.col("_from")).select(*[F.col("_to").alias(c) if c == label else F.col(f"_row.`{c}`").alias(c) for c in labels.columns])
    if positive is None:
        return labels.union(copied(labels, up))
    return labels.union(copied(labels.where(F.col(positive)), up)).union(copied(labels.where(~F.col(positive)), down))
