"""Vector operators against brute force, with nulls, non-finite components, copies and mixed lengths."""

import numpy as np
import pytest

from geoloom.llm import pivotperm, voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, v int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    made = [(i, (base[i % 60] + rng.normal(size=8) * (0.12 if i >= 60 else 0)).astype("f4").tolist(), i % 3) for i in range(180)]
    made += [(200 + i, made[0][1], 0) for i in range(6)] + [(210, None, 0), (211, [0.0] * 8, 0), (212, [1.0, None] + [0.0] * 6, 0), (213, [float("nan")] + [0.0] * 7, 1), (214, [float("inf")] + [1.0] * 7, 1), (215, [], 1), (216, made[1][1], None), (217, [1.0, 2.0], 1), (218, [1.0, 2.1], 1), (5, made[5][1], 2)]
    return made


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 7])
def test_links(spark, rows, monkeypatch, block):
    monkeypatch.setattr(pivotperm, "BLOCK", block)
    got = sorted(tuple(r) for r in pivotperm.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), shared=1).collect())
    near = [[] for _ in rows]
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ x and y @ y and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    near[i].append(j)
    top = [r[0] for r in rows]
    for _ in rows:
        for i, js in enumerate(near):
            top[i] = min([top[i], *(top[j] for j in js)])
    want = sorted((r[0], len(near[i]), top[i], top[i] == r[0]) for i, r in enumerate(rows))
    assert got == want
    assert pivotperm.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [8192, 16])
def test_top_k(spark, rows, monkeypatch, most):
    monkeypatch.setattr(voronoi, "ROWS", most)
    monkeypatch.setattr(voronoi, "QUERIES", most // 4)
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in voronoi.top_k(table, lambda i: i % 10 == 0, k=5, pivots=7).collect())
    whole = sorted({(i, tuple(np.floor(np.array(v, float) * 256).astype(int).tolist())) for i, v, _ in rows if good(v)})
    want = []
    for q, v in whole:
        if q % 10 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi.top_k(table.limit(0), lambda i: i % 10 == 0).count() == 0


def test_groups_are_left_out(spark):
    """Clustered vectors: the floors found first and the bounds keep most groups away from a query, and the answer is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.floor(256 * (centres[np.arange(2000) % 40] + rng.normal(size=(2000, 16)) * 0.05))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    data = voronoi._grouped(table, x[:40]).cache()
    summary = voronoi.Summary.of(data, x[:40])
    asked = table.where("id % 50 = 0")
    first = voronoi._solved(data, voronoi._sent_first(asked, summary, 16, 5), 5)
    floors = spark.createDataFrame([(int(q), float(np.sort(x @ x[q])[-6])) for q in range(0, 2000, 50)], "query_id long, floor double")
    sent = voronoi._sent_on(asked, floors, summary, 16, 5).count() + 2 * 40
    assert sent < 0.25 * 40 * len(summary.cells) and first.count() >= 200
    for q in x[::50]:
        bounds = summary.bounds(q)
        cell = np.array([r["cell"] for r in data.orderBy("id").select("cell").collect()]) if q is x[0] else None
        if cell is not None:
            assert all((x[cell == c] @ q).max() <= bounds[i] for i, c in enumerate(summary.cells))
    whole = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in voronoi.top_k(whole, lambda i: i % 50 == 0).collect())
    want = [(q, n + 1, i, -s) for q in range(0, 2000, 50) for n, (s, i) in enumerate(sorted((-int(x[i] @ x[q]), i) for i in range(2000) if i != q)[:5])]
    assert got == want


def test_links_with_registered_settings(spark):
    """The settings of the query, on vectors that do link: nothing below the threshold, and 0.9 of the links or more."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.3, base + rng.normal(size=base.shape) * 0.5])
    label = np.arange(len(x)) % 400 % 3
    table = spark.createDataFrame([(i, v, int(label[i]), 1, 2, 3) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int, key int, points int, n int")
    got = {r["vec_id"]: r for r in pivotperm.near_duplicates(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    counts = np.array([got[i]["n_links"] for i in range(len(x))])
    assert linked.sum() > 500 and (counts <= linked.sum(axis=1)).all() and counts.sum() >= 0.9 * linked.sum()


def test_large_integers_stay_exact():
    q, x = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0], [2.0**30, 2.0]])
    assert voronoi._products(q, x).tolist() == [[2**60 + 3, 2**60 + 6]]


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_no_worker_holds_a_vector_for_each_group(spark, monkeypatch, at_once):
    monkeypatch.setattr(voronoi, "SENT_AT_ONCE", at_once)
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, v array<double>")
    every = np.arange(50)
    summary = voronoi.Summary(every, np.ones(50, int), np.tile([1.0, 0.0], (50, 1)), *(np.full(50, x) for x in (-9.0, 9.0, 9.0, 9.0)))
    floors = spark.createDataFrame([(0, 10**6)], "query_id long, floor long")
    sent = voronoi._sent_on(asked, floors, summary, 2, 1)
    first = voronoi._sent_first(asked, summary, 2, 1)
    assert sorted((r["id"], tuple(r["v"]), r["cell"]) for r in sent.union(first).where("id > 0").collect()) == [(i, (float(i), 1.0), c) for i in range(1, 9) for c in every.tolist()]
    assert sent.where("id = 0").isEmpty()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(cells" in plan  # the rows of a query are made in the JVM, one at a time
