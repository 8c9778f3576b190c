"""A pair is compared in the first bucket that it is really in, whatever an earlier band of the 16-bit sketch says."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from geoloom.llm import components, minhash


def test_first_band_by_the_bucket_hashes(spark):
    sketch = np.arange(160, dtype="<u2").tobytes()  # both agree in 16 bits everywhere
    rest = lambda x: [(x * 1000 + b) << 8 | b for b in range(2, 32)]
    shared = 77 << 8 | 1
    classes = spark.createDataFrame([(1, bytearray(sketch), [5 << 8, shared, *rest(1)], 27, 4), (2, bytearray(sketch), [6 << 8, shared, *rest(2)], 27, 4)], "key long, sketch binary, bands array<long>, n_bytes long, n_shingles long")
    mixed = spark.createDataFrame([(shared, 1, 1), (shared, 2, 2)], "band long, key long, label long")
    texts = spark.createDataFrame([(1, "one two three four five six"), (2, "One two three four five six")], "key long, text string")
    links = minhash._across(mixed, classes, texts, least=0.5, n=3, percent=85)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]


def plain_partners(group, labels, band, low, high, least, percent):
    rows = group.to_dict("records")
    found = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a["block"] != low or b["block"] != high or (low == high and b["key"] <= a["key"]) or labels[i] == labels[j]:
                continue
            x, y = (np.frombuffer(r["sketch"], "<u2") for r in (a, b))
            small, large = sorted((a["n_shingles"], b["n_shingles"]))
            shared = [p for p, q in zip(a["bands"], b["bands"], strict=True) if p == q]
            if (x == y).sum() >= least * len(x) and 100 * small >= percent * large and shared and shared[0] == band:
                found.add((i, j))
    return found


@pytest.mark.parametrize("width", [12, 20, 160])
@pytest.mark.parametrize("low, high", [(0, 0), (0, 1)])
def test_partners_in_a_block(monkeypatch, width, low, high):
    """The first look at low bytes leaves out no pair, whatever the number of minima."""
    rng = np.random.default_rng(width)
    centre = rng.integers(0, 1 << 16, (4, width))
    rows = []
    for key in range(80):
        own = np.where(rng.random(width) < rng.choice([0.02, 0.25, 0.6]), rng.integers(0, 1 << 16, width), centre[key % 4])
        own = np.where(rng.random(width) < 0.1, own ^ 256, own)  # equal in the low byte alone
        bands = [int(b) << 8 | k for k, b in enumerate(rng.integers(0, 3, 4))]
        rows.append({"key": int(rng.integers(0, 1 << 40)), "block": int(rng.integers(0, 2)) if low != high else 0, "n_shingles": int(rng.integers(40, 60)), "bands": bands, "sketch": own.astype("<u2").tobytes()})
    group, labels = pd.DataFrame(rows), rng.integers(0, 12, 80)
    for lanes in (0, 8, 64):
        monkeypatch.setattr(minhash, "LANES", lanes)
        for band in (1 << 8, 2 << 8 | 1):  # a bucket's members all have its band
            group["bands"] = [[band if k == band & 255 else b for k, b in enumerate(r["bands"])] for r in rows]
            got = {(i, int(j)) for i, partners in minhash._plausible_in_block(minhash._members(group), labels, band, low, high, 0.6, 80) for j in partners}
            assert got == plain_partners(group, labels, band, low, high, 0.6, 80)


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_groups_across_batches(spark, size):
    """Groups that end within, at and beyond a batch's end name the rows that each group alone names."""
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 16, (3, 40))
    rows = []
    for g, n in enumerate([1, 2, 3, 40, 2, 1, 25, 2, 2, 60]):
        band = g << 8
        for k in range(n):
            own = np.where(rng.random(40) < rng.choice([0.02, 0.5]), rng.integers(0, 1 << 16, 40), centre[k % 3])
            rows.append((band, 0, g % 2, k % 2 if g % 2 else 0, g * 1000 + k, int(rng.integers(0, 9)), 50, [band, 1], own.astype("<u2").tobytes()))
    names = ["band", "low", "high", "block", "key", "label", "n_shingles", "bands", "sketch"]
    frame = pd.DataFrame(rows, columns=names)
    want = set()
    for (band, low, high), group in frame.groupby(["band", "low", "high"]):
        group = group.reset_index(drop=True)
        for i, j in plain_partners(group, group["label"].to_numpy(), band, low, high, 0.6, 80):
            want |= {group["key"][i], group["key"][j]}
    table = pa.Table.from_pandas(frame, preserve_index=False)
    held, got = None, set()
    for at in range(0, table.num_rows, size):
        part = table.slice(at, size) if held is None else pa.concat_tables([held, table.slice(at, size)]).combine_chunks()
        edges = minhash._group_edges(part)
        held = part.slice(edges[-1])
        if edges[-1]:
            got |= set(minhash._with_partners(part.slice(0, edges[-1]), edges, 0.6, 80)["key"].to_pylist())
    got |= set(minhash._with_partners(held, [0, held.num_rows], 0.6, 80)["key"].to_pylist())
    assert got == want and want


def test_components_of_later_links(spark):
    """Links that come in rounds give the components of all of them at once."""
    rng = np.random.default_rng(3)
    rounds = [[tuple(map(int, rng.integers(0, 60, 2))) for _ in range(n)] for n in (15, 0, 12, 20)]
    joined = None
    for links in rounds:
        joined = components.merged(joined, spark.createDataFrame(links, "u long, v long"))
    whole = components.components(spark.createDataFrame([x for links in rounds for x in links], "u long, v long"))
    alone = lambda df: {r["node"]: r["component"] for r in df.where("node <> component").collect()}
    assert alone(joined) == alone(whole) and alone(joined)
