"""Links at the threshold are found with the points of a large label, under the prefix and shared count of production."""

import numpy as np

from geoloom.llm import pivotperm


def test_links_with_thousands_of_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 64)))
    other = rng.normal(size=a.shape)
    other = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * other
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(np.concatenate([a, b]).tolist())], "vec_id long, embedding array<double>, label int")
    asked = []

    def points(vectors, vector, count):
        asked.append(count)
        return np.random.default_rng(6).normal(size=(count, 64))

    monkeypatch.setattr(pivotperm, "reference_points", points)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivotperm.near_duplicates(table, list_rows=6).collect())
    assert asked == [4096]
    assert got == [(i, 1, i % 1500) for i in range(3000)]
