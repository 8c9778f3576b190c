"""Splits, samples and dense numbers that come out alike on any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .orders import running


def draw(key: str, seed: int) -> list[Column]:
    """An order of keys that looks random: by the md5 of key and seed, then the key."""
    return [F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))), F.col(key)]


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """key, id: the different keys numbered from 0 in order."""
    return running(df.select(key).distinct(), [F.col(key).asc_nulls_last()]).select(key, F.col("_rank").cast("long").alias("id"))


def split(df: DataFrame, key: str, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """df with part: rows in the order of a hash of key are cut at the rounded shares."""
    total = df.count()
    part, at, done = F.lit(None).cast("string"), 0, 0.0
    for name, share in shares.items():
        done += share
        to = total if abs(done - 1) < 1e-9 else int(round(done, 9) * total + 0.5)
        part = F.when((F.col("_rank") >= at) & (F.col("_rank") < to), name).otherwise(part)
        at = to
    return running(df, draw(key, seed)).withColumn("part", part).drop("_rank")


def downsample(df: DataFrame, key: str, empty: str, most: float, seed: int = 0) -> DataFrame:
    """df with so few of its empty rows, those of the least hash, that they are a share of most or less."""
    n = df.agg(F.count_if(F.col(empty)).alias("empty"), F.count_if(~F.col(empty)).alias("full")).first()
    keep = min(n["empty"], int(most * n["full"] / (1 - most))) if most < 1 else n["empty"]
    few = running(df.where(F.col(empty)), draw(key, seed)).where(f"_rank < {keep}").drop("_rank")
    return df.where(~F.col(empty)).unionByName(few)


def subset_of_values(rows: DataFrame, by: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """by, missing (wanted names that no row of the group has, in order), subset (none is missing). Only wanted names are gathered."""
    have = rows.groupBy(by).agg(F.collect_set(F.when(F.col(value).isin(*wanted), F.col(value))).alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("_have")))
    return have.select(by, missing.alias("missing"), (F.size(missing) == 0).alias("subset"))
