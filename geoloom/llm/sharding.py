"""Weighted rendezvous hashing of record keys over shards, with DataFrame functions only.

Every (key, shard) pair has a hash u in (0, 1); a key belongs to the shard of the greatest weight / -ln(u). Shards take
keys in proportion to their weights, and the pairs of a key don't know of each other: a shard that is added takes keys
only into itself, one that goes away gives only its own to others, one whose weight grows only gains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that repeat each other go on as runs of at most so many.
RUN = 4096


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of parts joined by colons; a null part is empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _claim(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    return weight / -F.log(_unit(key, shard, F.lit(seed)))


def shard_of(key: Column, weights: Sequence[float], seed: int = 11) -> Column:
    """The shard, from 0, of a key; shards of weight 0 take nothing, ties go to the lesser shard, a null key counts as ''."""
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("weights are 0 or more, and one at least is above 0")
    table = F.array(*[F.lit(float(w)) for w in weights])
    claims = F.transform(table, lambda w, i: F.struct(_claim(key, i, w, seed).alias("claim"), (-i).alias("shard")))
    return (-F.array_max(claims)["shard"]).cast("int")


def grown_shard_of(key: Column, shard: Column, weights: Sequence[float], weight: float, seed: int = 11) -> Column:
    """Where a key of shard goes when a shard of weight is added behind weights: there or nowhere."""
    own = _claim(key, shard, F.element_at(F.array(*[F.lit(float(w)) for w in weights]), shard + 1), seed)
    new = F.lit(len(weights))
    return F.when(_claim(key, new, F.lit(float(weight)), seed) > own, new).otherwise(shard).cast("int")


def layout(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, seed: int = 11, rows_per_bin: int = 1 << 14) -> DataFrame:
    """A row per document: doc_id, size (UTF-8 bytes and one), text_crc32, law ('key'), shard, slot, grown_shard (with one more shard of the mean weight).

    slot numbers a shard's rows from 0 without gaps, in the order of a hash of doc_id, size and crc. A null text has no
    bytes (size 1, crc 0); a null doc_id is an empty key; rows that repeat each other have the same shard and slots of
    their own; other columns are left alone; an empty table gives no row. Only doc_id, size and crc are shuffled: rows
    that repeat each other are counted before the shuffle and go on as runs of RUN at most, which a hash spreads over
    the bins of their shard, so that neither a frequent id nor a frequent row is one task's work.
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    same = facts.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_all"))
    runs = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / RUN).cast("long"))).alias("_run"))
    placed = runs.select(
        "doc_id", "size", "text_crc32", "_run", F.least(F.col("_all") - F.col("_run") * RUN, F.lit(RUN)).alias("_n"),
        shard_of(key, weights, seed).alias("shard"), _unit(key, F.col("size"), F.col("text_crc32"), F.col("_run")).alias("_at"),
    )
    rows = written(placed.withColumn("grown_shard", grown_shard_of(key, F.col("shard"), weights, sum(weights) / len(weights), seed)), "shards")
    bins = rows.groupBy("shard").agg(F.ceil(F.sum("_n") / rows_per_bin).cast("long").alias("_bins"))  # a row for each shard
    binned = rows.join(F.broadcast(bins), "shard").withColumn("_bin", F.floor(F.col("_at") * F.col("_bins")).cast("long")).drop("_bins")
    earlier = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    starts = binned.groupBy("shard", "_bin").agg(F.sum("_n").alias("_in")).withColumn("_first", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    before = Window.partitionBy("shard", "_bin").orderBy("_at", "doc_id", "size", "text_crc32", "_run").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumn("_local", F.sum("_n").over(before) - F.col("_n")).join(starts, ["shard", "_bin"])
    first = F.col("_first") + F.col("_local")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 16, seed: int = 11, rows_per_file: int = 1 << 16) -> str:
    """docs as Parquet below path, a folder for each shard; returns the name of the folders' column (shard, or _shard, __shard, ... where docs has such a one).

    Rows are dealt to tasks by shard; Spark splits a large shard and joins small ones by their bytes (a rebalance), and a
    task writes files of rows_per_file rows at most.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), shard_of(F.col("doc_id"), weights, seed).alias("_shard"))
    dealt = held.hint("rebalance", "_shard").select("_doc.*", F.col("_shard").alias(name))
    dealt.write.partitionBy(name).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return name
