"""Vector columns, and reference points taken from a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """A vector that is there, not empty, and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def reference_points(vectors: DataFrame, vector: str, count: int) -> np.ndarray:
    """count different vectors of the length that most have, those of the least hash: the same in every run, fewer if there are fewer."""
    sizes = vectors.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    same = vectors.where(F.size(vector) == sizes[0]["d"]).select(F.xxhash64(vector, F.lit(29)).alias("h"), F.col(vector).alias("v"))
    return np.array([r["v"] for r in same.dropDuplicates(["h"]).orderBy("h").limit(count).collect()], np.float64)
