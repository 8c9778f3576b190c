"""Sharding, fill-in-the-middle and source divergence against plain versions, on odd tables too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import divergence, fim, sharding
from geoloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, shard int, n string, slot string, p string, block string, form string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    words = ["the", "The", "été", "naïve", "x1y", "Ünder", "ünder", "東京", "a-b", "well", "Z", "…", "<P>"[1:2], *(f"w{chr(97 + i)}" for i in range(20))]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), ["en", "de", None][i % 3], ["a", "b", None, "", "é"][i % 5]) for i in range(200)]
    out += [(300, None, "en", "a"), (301, "", "xx", "only"), (302, "a <M> b", "en", "a"), (303, "é" * 30_000 + "end", "en", "b"), (304, "𝄞x" * 9, "yy", "p"), (305, "1 2 3", "yy", "q")]
    out += [out[5]] * 3 + [(5, "other text", "en", "a"), (None, "no id", "de", "b"), (None, None, None, None)] + [(7, "hot", "en", "a")] * 9000
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    where = tmp_path_factory.mktemp("new")
    spark.createDataFrame([(*r, 1, "n", "s", "p", "b", "f") for r in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_sharding", "op12_fill_in_middle", "op13_source_divergence"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


# -- sharding


def unit(*parts):
    return (int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def best_of(key, weights):
    return max(range(len(weights)), key=lambda s: (weights[s] / -math.log(unit(key, s, 11)), -s))


def test_shards_of_odd_documents(spark, folder, rows):
    got = QUERIES["op11_sharding"](spark, folder).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["shard"] == best_of(r["doc_id"], [1.0] * 16) and r["grown_shard"] == best_of(r["doc_id"], [1.0] * 17)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(b) + 1, zlib.crc32(b)) for d, b in data)


def test_slots_are_the_same_for_any_bins(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few, many = (sorted(map(str, sharding.layout(docs, rows_per_bin=n).collect())) for n in (1 << 20, 7))
    assert few == many


def test_weights_share_the_keys_and_growth_moves_few(spark):
    weights, n = [1.0, 3.0, 0.0, 2.0], 6000
    own = sharding.shard_of(F.col("id"), weights)
    at = spark.range(n).select("id", own.alias("old"), sharding.grown_shard_of(F.col("id"), own, weights, 2.0).alias("grown"), sharding.shard_of(F.col("id"), [*weights, 2.0]).alias("fresh")).collect()
    counts = Counter(r["old"] for r in at)
    assert counts[2] == 0 and all(abs(counts[s] / n - weights[s] / 6) < 0.03 for s in (0, 1, 3))
    assert all(r["grown"] == r["fresh"] and r["fresh"] in (r["old"], 4) for r in at)
    assert abs(sum(r["fresh"] == 4 for r in at) / n - 2 / 8) < 0.03


def test_shards_without_weight_are_refused():
    for weights in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("id"), weights)


def test_written_shards_hold_every_row(spark, folder, rows, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name = sharding.write_shards(docs, f"{tmp_path}/out", rows_per_file=1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "_shard" and back.drop(name).exceptAll(docs).isEmpty() and back.count() == len(rows)
    assert back.where(F.col(name) != sharding.shard_of(F.col("doc_id"), (1.0,) * 16)).isEmpty()


# -- fill in the middle


def plain_cut(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return doc, n, *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_cut_documents(spark, folder, rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*r[:5], digest(r[5]), digest(t or "")) for (d, t, *_), r in zip(rows, (plain_cut(d, t) for d, t, *_ in rows), strict=True)]
    assert Counter(map(tuple, QUERIES["op12_fill_in_middle"](spark, folder).collect())) == Counter(want)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé東𝄞\n"), max_size=3000), st.integers(0, 60))
def test_every_boundary_is_found(text, error):
    at = fim.boundaries(np.frombuffer(text.encode(), np.uint8))
    assert at.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]
    index = fim.RankIndex(at, error)
    assert [index.offset(i) for i in range(len(text) + 1)] == at.tolist()
    assert np.abs(index.residuals.astype(int)).max() <= error + 1


def test_segments_are_few():
    ascii_text = fim.boundaries(np.frombuffer(b"x" * 100_000, np.uint8))
    assert len(fim.RankIndex(ascii_text).starts) == 1
    halves = fim.boundaries(np.frombuffer(("x" * 50_000 + "東" * 50_000).encode(), np.uint8))
    assert len(fim.RankIndex(halves).starts) <= 3


@pytest.mark.parametrize("text", ["<", "<P", "P><M", "a<S", ">M>", "<<", "S>é<"])
def test_marks_across_seams(spark, text):
    docs = spark.createDataFrame([(i, text * k) for i in range(60) for k in (1, 2)], "doc_id long, text string")
    made = fim.transform(docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert made.exceptAll(docs).isEmpty() and made.count() == docs.count()


# -- source divergence


def plain_audit(rows, least=3, top=200):
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    seen, groups, within = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", terms_of(text)
        within[lang].add(source)
        groups[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in within.items():
        kept = [t for t, d in seen[lang].items() if d >= least]
        cost = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        prices = {s: cost(groups[lang, s]) for s in sources}
        q = cost(sum((groups[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            p = prices[s]
            pairs = [(o, sum(far(p[t], prices[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, far(p[t], q[t])) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                best = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(best)]
    return out


def test_audit_of_odd_documents(spark, folder, rows):
    got = QUERIES["op13_source_divergence"](spark, folder)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[0] == "yy" and r[2] == "pair" and r[4] == 0 for r in want)


def test_audit_keeps_the_first_terms(spark, rows):
    docs = spark.createDataFrame([(d, t, l, s) for d, t, l, s in rows], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs, least_docs=1, top=4).collect())) == sorted(plain_audit(rows, least=1, top=4))


@pytest.mark.parametrize("tile", [1, 5, 2048])
def test_joint_tables_in_tiles(monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = np.random.default_rng(32)
    n = rng.integers(0, 5, (40, 6))
    prices = 1 + (10**9 * (n + 1)) // (n.sum(axis=0) + 40)
    t, s = np.nonzero(n)
    terms = pd.DataFrame({"term": [f"t{i}" for i in t], "source": [f"s{j}" for j in s], "n": n[t, s], "p": prices[t, s]})
    got = divergence._priced_pairs(terms, pd.DataFrame({"source": [f"s{j}" for j in range(6)], "p0": 1 + 10**9 // (n.sum(axis=0) + 40)}))
    with_terms = prices[n.any(axis=1)]
    want = {(f"s{a}", f"s{b}"): int(((with_terms[:, a] - with_terms[:, b]) ** 2 // with_terms[:, b]).sum()) for a in range(6) for b in range(6) if a != b}
    assert {(r.source, r.item): r.value for r in got.itertuples()} == want


def test_counts_are_sent_on_in_parts(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(d, t, l, s) for d, t, l, s in rows], "doc_id long, text string, lang string, source string")
    whole = sorted(map(str, divergence.term_counts(docs).collect()))
    monkeypatch.setattr(divergence, "HELD", 5)
    assert sorted(map(str, divergence.term_counts(docs).collect())) == whole


def test_prices_of_great_counts(spark):
    n, total, kept = 10**13, 10**15, 10**8
    got = spark.range(1).select(divergence.price(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), divergence.distance(F.lit(10**9), F.lit(1)).alias("f")).first()
    assert tuple(got) == (1 + 10**9 * (n + 1) // (total + kept), (10**9 - 1) ** 2)
