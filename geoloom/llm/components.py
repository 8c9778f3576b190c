"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over edges (u, v) with u > v: large-star joins a node's larger neighbours to the least of all, small-star a node and its smaller ones.

    The least neighbour is an aggregate, combined before the shuffle, and comes back by a join that Spark can split, so a
    node with very many neighbours is never one task's work.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("_m"))
        made = near.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        kept = edges.join(least, F.col("u") == F.col("_u"))
        made = kept.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
    return made.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node reachable. Loops and repeats are ignored."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    while True:
        edges = written(_stars(_stars(edges, True), False), "edges")
        # All are stars when no node has two centres, or is one and has one.
        ends = edges.select("u", F.lit(1).alias("below")).union(edges.select("v", F.lit(0))).groupBy("u").agg(F.sum("below").alias("centres"), F.min("below").alias("least"))
        if ends.where("centres > 1 or centres <> least").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def merged(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links (u, v): only the components that they touch are joined anew, by their least nodes."""
    if joined is None:
        return components(links)
    old = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    labelled = links.join(old("u"), "u", "left").join(old("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    more = components(labelled)
    moved = joined.join(more.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left")
    fresh = more.join(joined.select("node"), "node", "left_anti")
    return written(moved.select("node", F.coalesce("_c", "component").alias("component")).union(fresh), "components")
