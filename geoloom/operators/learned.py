"""Clusters, classifiers and region tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def breaks(values: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The cluster, 1..k by mean, of each of some ascending values: the k-means of least inertia, by dynamic programming over cuts."""
    n, k, v = len(values), min(k, len(values)), values - np.average(values, weights=weights)
    sums = [np.concatenate([[0.0], np.cumsum(weights * v**e)]) for e in range(3)]

    def inertia(i: np.ndarray, j: int) -> np.ndarray:
        """Of the values i..j, for each of i."""
        w, x, xx = (s[j + 1] - s[i] for s in sums)
        return xx - x * x / w

    best = np.array([inertia(np.zeros(1, int), j)[0] for j in range(n)])
    cuts = []
    for c in range(1, k):
        new, cut = np.full(n, np.inf), np.zeros(n, int)
        for j in range(c, n):
            i = np.arange(c, j + 1)
            cost = best[i - 1] + inertia(i, j)
            cut[j] = i[cost.argmin()]
            new[j] = cost.min()
        best = new
        cuts.append(cut)
    out, j = np.ones(n, int), n - 1
    for c in range(k - 1, 0, -1):
        first = cuts[c - 1][j]
        out[first : j + 1] = c + 1
        j = first - 1
    return out


def zoned(cells: DataFrame, by: Sequence[str], value: str, zones: int, name: str = "zone", bins: int = 1024) -> DataFrame:
    """cells with name, 1..zones: k-means of one value within each group of by, zones numbered by their means.

    A group is clustered from the counts of its values, in at most bins equal steps between its least and greatest one (a
    value that isn't finite has no zone); Spark combines the counts before the shuffle, so a group's task holds bins at most.
    """
    finite = F.col(value).cast("double").between(-1e300, 1e300)
    span = cells.where(finite).groupBy(*by).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    step = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * (bins - 1) + 0.5)).otherwise(0).cast("int")
    stepped = cells.join(span, list(by), "left").withColumn("_step", F.when(finite, step))
    counts = stepped.where("_step is not null").groupBy(*by, "_step").agg(F.count("*").alias("_n"), F.avg(value).alias("_v"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_step")
        return group[[*by, "_step"]].assign(**{name: breaks(group["_v"].to_numpy(float), group["_n"].to_numpy(float), zones).astype("int32")})

    types = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    found = counts.groupBy(*by).applyInPandas(cluster, f"{types}, _step int, {name} int")
    return stepped.join(found, [*by, "_step"], "left").select(*[F.col(f"`{c}`") for c in cells.columns], name)


def anchors(boxes: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """w, h of count typical boxes of two pixels or more: k-means of sizes scaled by their deviation, by area."""
    sizes = boxes.select((F.col("xmax") - F.col("xmin")).cast("double").alias("w"), (F.col("ymax") - F.col("ymin")).cast("double").alias("h")).where("w >= 2 and h >= 2")
    s = sizes.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    sw, sh = s["w"] or 1.0, s["h"] or 1.0
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(sizes.select((F.col("w") / sw).alias("a"), (F.col("h") / sh).alias("b")))
    centres = KMeans(k=count, seed=seed, featuresCol="_x").fit(ready).clusterCenters()
    found = sorted(((round(float(c[0] * sw), 4), round(float(c[1] * sh), 4)) for c in centres), key=lambda p: p[0] * p[1])
    return boxes.sparkSession.createDataFrame(found, "w double, h double")


def codebook(vectors: DataFrame, key: str, vector: str, size: int, seed: int = 1) -> DataFrame:
    """key, word: the nearest of size centres of all vectors."""
    ready = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return KMeans(k=size, seed=seed, featuresCol="_x", predictionCol="word").fit(ready).transform(ready).select(key, "word")


def predicted(cells: DataFrame, bands: Sequence[str], label: str, seed: int = 1, trees: int = 5) -> DataFrame:
    """Every fifth cell by hash with prediction, by gradient-boosted trees with balanced weights that learned from the others."""
    n = cells.groupBy(label).agg(F.count("*").alias("_n"))
    total, kinds = cells.count(), n.count()
    weighted = cells.join(F.broadcast(n), label).withColumn("_w", F.lit(float(total)) / (kinds * F.col("_n")))  # a row for each label
    ready = VectorAssembler(inputCols=list(bands), outputCol="_x").transform(weighted).withColumn("_fold", F.pmod(F.xxhash64("scene_id", "r", "c"), F.lit(5)))
    model = GBTClassifier(labelCol=label, featuresCol="_x", weightCol="_w", maxIter=trees, maxDepth=4, seed=seed).fit(ready.where("_fold <> 0"))
    return model.transform(ready.where("_fold = 0")).select(*cells.columns, "prediction")


def classified(cells: DataFrame, bands: Sequence[str], label: str, seed: int = 1, trees: int = 5) -> DataFrame:
    """f1, jaccard, n of predicted."""
    hit, truth, pred = ((F.col("prediction") == 1) & (F.col(label) == 1)), F.col(label) == 1, F.col("prediction") == 1
    s = predicted(cells, bands, label, seed, trees).agg(F.count_if(hit).alias("tp"), F.count_if(truth).alias("t"), F.count_if(pred).alias("p"), F.count("*").alias("n"))
    return s.select(F.round(2 * F.col("tp") / (F.col("t") + F.col("p")), 4).alias("f1"), F.round(F.col("tp") / (F.col("t") + F.col("p") - F.col("tp")), 4).alias("jaccard"), "n")


def tall(cells: DataFrame, by: Sequence[str], value: str, zones: int, least: float, on: int = 255, name: str = "tall") -> DataFrame:
    """cells with name: on where the mean of a cell's cluster is above least, else 0.

    Values of least or less count as 0; each group of by is clustered with them (see zoned), every cell takes its
    cluster's mean, and that is held against least. Rows of a null group have no cluster and aren't on.
    """
    flat = cells.withColumn("_flat", F.when(F.col(value) > least, F.col(value)).otherwise(0).cast("double"))
    found = zoned(flat, by, "_flat", zones, name="_zone")
    means = found.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_zone").alias("_z")).agg(F.avg("_flat").alias("_mean"))
    on_zone = F.col("_zone") == F.col("_z")
    for c in by:
        on_zone = on_zone & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return found.join(means, on_zone, "left").select(*[F.col(f"`{c}`") for c in cells.columns], F.when(F.col("_mean") > least, on).otherwise(0).alias(name))


def region_table(cells: DataFrame, value: str, names: Mapping[int, str]) -> DataFrame:
    """One row a region of cells (r, c, value, region): class name, cells, bounds and row runs (r, first c, length)."""
    run = F.col("c") - F.row_number().over(Window.partitionBy("region", "r").orderBy("c"))
    runs = cells.withColumn("_run", run).groupBy("region", value, "r", "_run").agg(F.min("c").alias("c0"), F.count("*").alias("len"))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return runs.groupBy("region", table[F.col(value)].alias("class")).agg(
        F.sum("len").alias("cells"), F.min("r").alias("r0"), F.min("c0").alias("c0"), F.max("r").alias("r1"), F.max(F.col("c0") + F.col("len") - 1).alias("c1"),
        F.to_json(F.sort_array(F.collect_list(F.struct("r", F.col("c0").alias("c"), F.col("len").alias("n"))))).alias("runs"),
    )
