"""Grids, large kernels, hierarchies, simplification and gap filling against plain versions."""

import math
import random
import shutil
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import grids, hierarchies, lines, raster
from geoloom.streaming.events import LastClear, filled, rocksdb, run_to_end


def table(spark, cells, schema="r int, c int, v double"):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], schema)


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(51)
    return {(r, c): float(rng.randint(0, 90)) for r in range(-9, 40) for c in range(-7, 33) if rng.random() < 0.8}


@pytest.mark.parametrize("size", [8, 256])
@pytest.mark.parametrize("onto", [grids.Grid(3.3, 0.7, -2.1, 1.9), grids.Grid(0.0, 2.0, 0.0, 2.0), grids.Grid(-9.0, 1.0, 44.5, -1.5), grids.Grid(5.0, 0.6, 5.0, 0.8, 0.5, -0.4)])
def test_resampled_cells(spark, cells, size, onto):
    """Other ratio and origin, a whole ratio, rows that run upwards, and a turned grid; nodata, missing cells and borders."""
    source, own = table(spark, cells), grids.Grid(-1.0, 1.25, 2.0, 1.5)
    target = onto.cells(spark, 45, 45)
    got = {(r["r"], r["c"]): r["v"] for r in grids.align(source, own, target, onto, "v", nodata=7.0, size=size).collect()}
    near = {(r["r"], r["c"]): r["v"] for r in grids.align(source, own, target, onto, "v", method="nearest", nodata=7.0, size=size).collect()}
    data, want, want_near = {k: v for k, v in cells.items() if v != 7.0}, {}, {}
    for r in range(45):
        for c in range(45):
            x, y = onto.x0 + (c + 0.5) * onto.dx + (r + 0.5) * onto.rx, onto.y0 + (c + 0.5) * onto.ry + (r + 0.5) * onto.dy
            sr, sc = (y - 2.0) / 1.5 - 0.5, (x + 1.0) / 1.25 - 0.5
            four = [(data[k], w) for k in ((math.floor(sr) + i, math.floor(sc) + j) for i in (0, 1) for j in (0, 1)) if k in data and (w := (1 - abs(sr - k[0])) * (1 - abs(sc - k[1]))) > 0]
            if four:
                want[r, c] = sum(v * w for v, w in four) / sum(w for _, w in four)
            if (k := (math.floor(sr + 0.5), math.floor(sc + 0.5))) in data:
                want_near[r, c] = data[k]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    assert near == want_near


def test_scenes_onto_one_grid(spark, cells):
    shifted = {k: v + 1 for k, v in cells.items() if k[0] < 3}
    both = table(spark, cells).withColumn("scene", F.lit("a")).union(table(spark, shifted).withColumn("scene", F.lit("b")))
    onto = grids.Grid(0.25, 1.0, 0.25, 1.0)
    got = grids.align(both, grids.Grid(0, 1, 0, 1), onto.cells(spark, 30, 30), onto, "v", by=["scene"], size=16)
    for name, own in (("a", cells), ("b", shifted)):
        one = grids.align(table(spark, own), grids.Grid(0, 1, 0, 1), onto.cells(spark, 30, 30), onto, "v", size=16)
        mine = got.where(F.col("scene") == name).drop("scene")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, one.collect()))


def test_grids_are_checked(spark):
    empty = spark.createDataFrame([], "r int, c int, v double")
    with pytest.raises(ValueError):
        grids.align(empty, grids.Grid(0, 1, 0, 1), empty.select("r", "c"), grids.Grid(0, 1, 0, 1), "v", method="cubic")
    with pytest.raises(ValueError):
        grids.Grid(0, 0, 0, 1).place(F.lit(1.0), F.lit(1.0))
    assert grids.align(empty, grids.Grid(0, 1, 0, 1), empty.select("r", "c"), grids.Grid(0, 1, 0, 1), "v").isEmpty()


@pytest.mark.parametrize("shape", ["rect", "cross", "ellipse"])
@pytest.mark.parametrize("size", [1, 3, 7])
def test_kernels_as_the_joins_have_them(spark, cells, shape, size):
    mask = spark.createDataFrame([(r, c, int(v)) for (r, c), v in cells.items()], "r int, c int, cls int")
    offsets = raster.kernel(size, shape)
    plain = {"dilate": raster.dilate, "erode": raster.erode, "open": raster.opening, "close": raster.closing, "gradient": raster.gradient}
    for op, f in plain.items() if size == 3 else [("dilate", raster.dilate), ("close", raster.closing)]:
        got = grids.focal(mask, op, size, shape, tile=12)
        assert got.schema["cls"].dataType == mask.schema["cls"].dataType
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(mask, offsets).collect())), op


def test_a_kernel_of_31_and_iterations(spark, cells):
    mask = spark.createDataFrame([(r, c, int(v)) for (r, c), v in cells.items()], "r int, c int, cls int")
    near = lambda own, h: {(r, c): max(v for (y, x), v in own.items() if abs(y - r) <= h and abs(x - c) <= h) for r, c in own}
    assert {(r["r"], r["c"]): r["cls"] for r in grids.focal(mask, "dilate", 31).collect()} == near(cells, 15)
    twice = {(r["r"], r["c"]): r["cls"] for r in grids.focal(mask, "dilate", 5, iterations=2, tile=16).collect()}
    assert twice == near(near(cells, 2), 2)
    for bad in ({"op": "dilate", "size": 4}, {"op": "blur", "size": 3}, {"op": "erode", "size": 3, "iterations": 0}):
        with pytest.raises(ValueError):
            grids.focal(mask, **bad)


def test_running_maxima():
    a = np.random.default_rng(52).normal(size=(3, 40))
    for width in range(1, 41):
        assert (grids._running_max(a, width) == np.lib.stride_tricks.sliding_window_view(a, width, axis=1).max(axis=-1)).all()


# -- hierarchies


def test_closure_of_several_parents(spark):
    rng = random.Random(53)
    edges = [(c, p) for c in range(1, 60) for p in {rng.randrange(c) for _ in range(rng.randint(1, 3))}] + [(100 + k, 101 + k) for k in range(70)]
    above = {}
    for c, p in edges:
        above.setdefault(c, set()).add(p)

    def up(n):
        found, todo = set(), list(above.get(n, ()))
        while todo:
            p = todo.pop()
            if p not in found:
                found.add(p)
                todo += above.get(p, ())
        return found

    got = hierarchies.closure(spark.createDataFrame([*edges, edges[0], (None, 3), (3, None)], "child long, parent long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, a) for n in above for a in up(n))


def test_cycles_are_errors(spark):
    for edges in ([(1, 1)], [(1, 2), (2, 3), (3, 1)], [(k, k + 1) for k in range(9)] + [(9, 4)]):
        with pytest.raises(ValueError, match="cycle"):
            hierarchies.closure(spark.createDataFrame(edges, "child long, parent long"))


def test_labels_up_and_down(spark):
    edges = spark.createDataFrame([("dog", "animal"), ("cat", "animal"), ("pug", "dog"), ("pug", "toy")], "child string, parent string")
    labels = spark.createDataFrame([(1, "pug", True, "x"), (2, "animal", False, "y"), (3, "rock", True, "z"), (4, "dog", False, "w"), (5, None, True, None)], "image int, label string, there boolean, _from string")
    got = sorted(str(tuple(r)) for r in hierarchies.expand(labels, edges, "label", positive="there").collect())
    want = [(1, x, True, "x") for x in ("pug", "dog", "animal", "toy")] + [(2, x, False, "y") for x in ("animal", "dog", "cat", "pug")] + [(3, "rock", True, "z"), (4, "dog", False, "w"), (4, "pug", False, "w"), (5, None, True, None)]
    assert got == sorted(map(str, want))
    boxes = sorted((r["image"], r["label"]) for r in hierarchies.expand(labels.where("image = 4"), edges, "label").collect())
    assert boxes == [(4, "animal"), (4, "dog")]


# -- simplification


def recursive(points, tolerance):
    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    if len(points) < 3:
        return points
    far = [distance(p, points[0], points[-1]) for p in points[1:-1]]
    at = far.index(max(far)) + 1
    if far[at - 1] <= tolerance:
        return [points[0], points[-1]]
    return recursive(points[: at + 1], tolerance)[:-1] + recursive(points[at:], tolerance)


def test_simplified_paths(spark):
    rng = random.Random(54)
    paths = []
    for k in range(60):
        x = y = 0.0
        path = []
        for _ in range(rng.randint(1, 120)):
            x, y = x + rng.random(), y + rng.uniform(-1, 1)
            path.append((x, y))
        if k % 3 == 0 and len(path) > 3:
            path.append(path[0])
        paths.append((k, path))
    df = spark.createDataFrame([*paths, (90, None), (91, []), (92, [(1.0, 1.0)] * 5)], "id int, path array<struct<x:double,y:double>>")
    for tolerance in (0.3, 2.0):
        got = {r["id"]: r["p"] and [tuple(p) for p in r["p"]] for r in df.select("id", lines.simplified(F.col("path"), tolerance).alias("p")).collect()}
        for k, path in paths:
            want = recursive(path, tolerance)
            if path[0] == path[-1] and len(want) < 4:
                want = path
            assert got[k] == want, k
        assert got[90] is None and got[91] in ([], None) and len(got[92]) == 5


def test_a_long_path_needs_no_recursion():
    x = np.arange(30_000.0)
    keep = lines.keep_points(x, (x % 2) * 5 + x * x / 1e4, 0.5)
    assert keep.all() or keep.sum() > 20_000
    assert lines.keep_points(x, 2 * x, 0.1).sum() == 2


# -- gap filling


def test_late_rows_get_the_answer_of_a_batch(spark, tmp_path, monkeypatch):
    """One user has most rows; rows come up to two hours late, in later micro-batches; chunks are small."""
    monkeypatch.setattr(LastClear, "CHUNK", 16)
    rng, start = random.Random(55), datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=3 * i + rng.randint(0, 2)), 1 if rng.random() < 0.8 else rng.randint(2, 5), i, rng.random() if rng.random() < 0.4 else None) for i in range(400)]
    rows += [(rows[10][0], 1, 1000 + k, float(k)) for k in range(40)]  # ties in time
    want, last = {}, {}
    for ts, user, event, clear in sorted(rows, key=lambda r: (r[0], r[2])):
        last[user] = clear if clear is not None else last.get(user)
        want[user, event] = last[user]
    arrival = sorted(rows, key=lambda r: r[0] + timedelta(minutes=rng.uniform(0, 110)))
    schema = "ts timestamp, user_id long, event_id long, clear double"
    folder, batches = tmp_path / "in", [arrival[i : i + 60] for i in range(0, len(arrival), 60)] + [[(start + timedelta(days=9), None, None, None)]]
    folder.mkdir()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        part = next((tmp_path / str(i)).glob("*.parquet"))
        shutil.move(part, folder / f"{i:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with rocksdb(spark):
        got = run_to_end(filled(stream, "2 hours"), "append", "late")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    found = {(r["user_id"], r["event_id"]): r["filled"] for r in got.where("user_id is not null").collect()}
    assert found == want


class _Held:
    """A key's states in memory, with the number of calls to them."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls, self.most = None, {}, set(), 0, 0

    def _called(self, result=None):
        self.calls += 1
        return result

    getMapState = getValueState = lambda self, *_: self
    exists = lambda self: self._called(self.value is not None)
    get = lambda self: self._called(self.value)
    update = lambda self, value: self._called(setattr(self, "value", value))
    getValue = lambda self, key: self._called(self.map[key])
    removeKey = lambda self, key: self._called(self.map.pop(key))
    registerTimer = lambda self, at: self._called(self.timers.add(at))
    deleteTimer = lambda self, at: self._called(self.timers.remove(at))

    def updateValue(self, key, value):
        self.most = max(self.most, len(value[0]))
        self.map[key] = self._called(value)


@pytest.mark.parametrize("chunk", [100_000, 37])
def test_users_of_a_bucket_share_the_calls_to_its_state(monkeypatch, chunk):
    """1000 users in one bucket, two batches that overlap in time: a few calls in all where a chunk holds them, none for each user."""
    monkeypatch.setattr(LastClear, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"us": rng.integers(0, 500, 4000) * 1000, "event_id": rng.permutation(4000), "user_id": rng.integers(0, 1000, 4000), "clear": np.where(rng.random(4000) < 0.4, rng.random(4000), np.nan)})
    arrival = rows.iloc[np.argsort(rows["us"] + rng.integers(0, 100_000, 4000))]
    held, processor, got = _Held(), LastClear(), []
    processor.init(held)
    for batch, passed in ((arrival[:2500], 150), (arrival[2500:], 300), (arrival[:0], 10_000)):
        frames = [batch[i : i + 600].reset_index(drop=True) for i in range(0, len(batch), 600)]
        if frames:
            list(processor.handleInputRows((5,), iter(frames), None))
        assert len(held.timers) == 1
        held.timers.clear()
        got += processor.handleExpiredTimer((5,), SimpleNamespace(getCurrentWatermarkInMs=lambda p=passed: p), None)
    assert not held.map and not held.timers and held.most <= chunk * 40
    assert chunk < 4000 or held.calls < 60
    found = pd.concat(got)
    assert set(found["key"]) == {5} and len(found) == 4000
    inorder = rows.sort_values(["us", "event_id"])
    want = dict(zip(inorder["event_id"], inorder.groupby("user_id")["clear"].ffill(), strict=True))
    assert all(found.groupby("event_id").size() == 1)
    for event, value in zip(found["event_id"], found["filled"], strict=True):
        assert value == want[event] or (np.isnan(value) and np.isnan(want[event]))
