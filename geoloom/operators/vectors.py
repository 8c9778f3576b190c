"""Search, clustering and whitening of vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dot_topk(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, block: int = 512, rows: int = 16384) -> DataFrame:
    """q, id, dot, rank: the k largest inner products (rounded to 6 places) of each query with the index, but for its own row; ties to smaller ids.

    Queries in blocks of about `block` meet the index in parts of about `rows`: each pair is one matrix product, which
    keeps k a query, and the few left are merged by a window.
    """
    blocks, parts = (max(1, -(-table.count() // size)) for table, size in ((queries, block), (index, rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    blocks, rows = (
        queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), dealt(blocks).alias("a"), every(parts).alias("b")),
        index.select(F.col(key).alias("id"), F.col(vector).alias("v"), dealt(parts).alias("b"), every(blocks).alias("a")),
    )

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("id", ignore_index=True)
            ids, dots = x["id"].to_numpy(), np.round(np.stack(list(q["v"])) @ np.stack(list(x["v"])).T, 6)
            for name, row in zip(q["q"].tolist(), dots, strict=True):
                order = np.argsort(-row, kind="stable")[: k + 1]
                out += [(name, ids[i], row[i]) for i in order if ids[i] != name][:k]
        return pd.DataFrame(out, columns=["q", "id", "dot"]).astype({"q": "int64", "id": "int64", "dot": "float64"})

    local = blocks.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInPandas(best, "q long, id long, dot double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "id"))
    return local.withColumn("rank", rank).where(f"rank <= {k}").select("q", "id", "dot", "rank")


def whitening(pairs: DataFrame, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) learned from matching vectors: inverse Cholesky of the differences' covariance, then the principal axes.

    Sums of products are taken in the tasks; the driver solves one small system of the vectors' length.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x, y = np.stack(list(frame[a])).astype(float), np.stack(list(frame[b])).astype(float)
                d = x - y
                part = [np.array([len(x)]), x.sum(axis=0), (x.T @ x).ravel(), (d.T @ d).ravel()]
                total = part if total is None else [s + p for s, p in zip(total, part, strict=True)]
        if total is not None:
            yield pd.DataFrame({"part": [t.tolist() for t in total], "i": range(4)})

    rows = pairs.select(a, b).mapInPandas(sums, "part array<double>, i int")
    merged = {r["i"]: np.array(r["s"]) for r in rows.select("i", F.posexplode("part")).groupBy("i", "pos").agg(F.sum("col").alias("v")).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("s")).collect()}
    n, mean = merged[0][0], merged[1] / merged[0][0]
    d = len(mean)
    covariance = merged[3].reshape(d, d) / n
    p = np.linalg.inv(np.linalg.cholesky(covariance + 1e-9 * np.eye(d)))
    second = p @ (merged[2].reshape(d, d) / n - np.outer(mean, mean)) @ p.T
    values, axes = np.linalg.eigh(second)
    return mean, axes[:, np.argsort(-values)].T @ p


def whitened(vectors: DataFrame, vector: str, mean: np.ndarray, projection: np.ndarray, dims: int) -> DataFrame:
    """vectors with the column replaced by its projection on the first dims axes, of length 1."""

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = (np.stack(list(v)).astype(float) - mean) @ projection[:dims].T
        return pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))

    return vectors.withColumn(vector, project(F.col(vector)))
