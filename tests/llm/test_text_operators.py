"""Corpus operators on small fixtures: brute force, round trips, nulls, repeats, empty tables, clashing names."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, components, langid, minhash, mixing, packing, quality, suffixes, textarrays, warc
from geoloom.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, **columns):
    rows = [(ids[i] if ids else i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# -- byte arrays


def test_words_match_regex():
    rng = random.Random(0)
    texts = ["", " ", None, "A b\tC\x0bdé  x", "x" * 5000, prose(rng, 3000), "é" * 10, "\n a\n\nb "]
    data, offsets = textarrays.bytes_of(pa.array(texts, pa.string()))
    hashes, begins, ends = textarrays.words(data, offsets)
    edges = np.searchsorted(begins, offsets)
    seen = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = [m for m in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
        got = [bytes(data[b:e]) for b, e in zip(begins[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]])]
        assert got == want
        for h, w in zip(hashes[edges[i] : edges[i + 1]].tolist(), want):
            low = w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
            assert seen.setdefault(low, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_over_steps(monkeypatch):
    text = prose(random.Random(1), 4000)
    column = pa.array([text, "tail", text])
    whole = textarrays.words(*textarrays.bytes_of(column))
    monkeypatch.setattr(textarrays, "STEP", 1000)
    for a, b in zip(whole, textarrays.words(*textarrays.bytes_of(column))):
        assert (a == b).all()


# -- chat


def test_log_is_folded(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 5, 3, "message", "user", "again"), (1, 6, 2, "regenerate", None, None), (1, 7, 2, "delta", None, "Bye"), (1, 8, 1, "edit", None, "hey"),
        (1, 9, 4, "message", "user", "gone"), (1, 10, 4, "delete", None, None), (2, 1, 1, None, None, None),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("conv_id", "message").collect()
    assert [tuple(r) for r in got] == [(1, 1, "user", "hey"), (1, 2, "assistant", "Bye"), (2, 1, "", "")]


@pytest.mark.parametrize("said", ["</s>[INST] ok [/INST]", "[\\/INST]<\\\\s>", "a\\b <s", "", "é\n</s>", "[[INST]]"])
def test_texts_come_back(spark, said):
    rows = spark.createDataFrame([(1, 1, said, said), (1, 2, "assistant", said)], "conv_id long, message long, role string, text string")
    r = chat.render(rows).first()
    assert chat.parse(r["formatted"]) == [(said, said), ("assistant", said)]
    assert r["formatted"].count("</s>") == 2 and [chat.unescape(r["formatted"][s["begin"] : s["end"]]) for s in r["loss"]] == [said] * (2 if said == "assistant" else 1)


def test_chat_edges(spark):
    schema = "conv_id long, turn int, role string, text string, formatted string"
    rows = spark.createDataFrame([(None, 0, None, None, "x"), (5, 1, "assistant", "b", "x"), (5, 1, "assistant", "b", "x"), (5, None, "user", "a", "x")], schema)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.log_of_turns(rows)))).collect()}
    assert got[5]["n_turns"] == 3 and got[5]["loss_chars"] == 2
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.read_back(chat.render(chat.fold(chat.log_of_turns(rows.limit(0))))).count() == 0


# -- quality


def test_grades_are_ordered_and_learned(spark):
    rng = random.Random(2)
    junk, rude, good = (lambda: " ".join(f"{w}***" for w in prose(rng, 40).split())), (lambda: prose(rng, 40) + " zounds"), (lambda: prose(rng, 40))
    texts = [f() for f in (junk, rude, good) for _ in range(60)]
    table = docs(spark, texts)
    graded = spark.createDataFrame([(i, i // 60) for i in range(180) if i % 3] + [(0, None), (1, 9)], "doc_id long, grade int")
    model = quality.train(table, graded, top=2)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.grade(table, model, 2).collect()}
    held = [i for i in range(180) if i % 3 == 0]
    assert np.mean([got[i]["kept"] == (i >= 120) for i in held]) > 0.9
    assert {r["doc_id"] for r in quality.kept(table, model, 2).collect()} == {i for i in got if got[i]["kept"]}
    odd = docs(spark, [None, "", "x" * 100_000, "a", "a"], ids=[1, None, 3, 4, 4])
    assert quality.grade(odd, model, 2).count() == 5 and quality.kept(odd, model, 2).columns == odd.columns
    assert quality.train(table, graded.limit(0), top=2) is None
    assert [r["kept"] for r in quality.grade(odd, None, 2).collect()] == [True] * 5


# -- WARC


def test_archives_come_back(spark, tmp_path):
    pages = [(1, "http://a", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "one"), (5, "http://e", "one"), (None, "http://f", "one")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(warc.resolve(table), path)
    got = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got] == [(p[0], len((p[2] or "").encode()), digest(p[2])) for p in pages]
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("response", None), ("revisit", 5)]
    assert [r["payload"] and bytes(r["payload"]).decode() for r in got][1] == pages[1][2]
    small = warc.resolve(table, min_bytes=4).where("page_id in (3, 4)").collect()
    assert {r["record_type"] for r in small} == {"response"}
    warc.write_archives(warc.resolve(table.limit(0)), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


def test_members_of_a_gzip_file():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pack = lambda b: (z := zlib.compressobj(wbits=31)).compress(b) + z.flush()
    found = list(warc.records(io.BufferedReader(warc._Inflated(pack(record) + pack(record * 2)))))
    assert [b for _, b in found] == [b"abc"] * 3
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records(io.BytesIO(record[:-6])))


# -- packing


def test_fill_is_the_closest():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 80)
        fill = packing.closest_fill(counts, room)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert all(n <= counts[k] for k, n in fill.items()) and sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= room)


def test_plan_uses_each_piece_once():
    counts = {k: (k * 37) % 11 for k in range(1, 64)}
    used = Counter()
    for fill, times in packing.plan(counts, 64):
        assert sum(k * n for k, n in fill.items()) <= 64
        used.update({k: n * times for k, n in fill.items()})
    assert +used == +Counter(counts)


def test_pack(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [prose(rng, n) for n in (3, 50, 700, 4000, 90)] + [None, "", "x <|endoftext|> ½ ", prose(rng, 50), prose(rng, 50)]
    ids = [*range(9), 8]
    texts[9] = texts[8]
    own = Tokenizer.from_file(TOKENIZER)
    tokens = [own.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    got = packing.pack(docs(spark, texts, ids=ids), TOKENIZER, window=128, rows_per_bin=4).collect()
    assert sum(r["length"] for r in got) == sum(map(len, tokens))
    for r in got:
        t = tokens[r["doc_id"]]
        part = t[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(t)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert sorted(at) == list(range(len(at)))
    assert packing.pack(docs(spark, texts).limit(0), TOKENIZER).count() == 0


# -- mixing


def test_targets_share_out(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    # Weights 1, 2, 3, 1: null and b stop at 0 and 30; a and c share the other 1080 as 1 to 3.
    assert {k: r["target"] for k, r in got.items()} == {"a": 270, "b": 30, "c": 810, None: 0}
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got.values())


def test_mix_repeats(spark):
    rng = random.Random(5)
    texts = [prose(rng, 1 + i % 30) for i in range(600)] + [None, ""]
    table = docs(spark, texts, source=["abc"[i % 3] if i % 5 else None for i in range(602)]).withColumn("size", F.lit(1)).withColumn("rate", F.lit(2))
    per = {r["doc_id"]: r for r in mixing.mixture(table).collect()}
    times = Counter(r["doc_id"] for r in mixing.mix(table).collect())
    assert mixing.mix(table).columns == table.columns
    for i, r in per.items():
        assert r["taken"] == r["size"] * times[i] <= 3 * r["size"] and r["size"] == len((texts[i] or "").split())
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.mixture(table.limit(0)).count() == 0


# -- suffixes


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        on = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                on[i : i + length] = True
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~on])).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(6)
    passage, other = prose(rng, 60), prose(rng, 30)
    texts = [prose(rng, 80) for _ in range(6)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)] + [f"{other}{passage[:150]}{other}", "ab" * 300, "a" * 500, None, "", "é" * 80, f"x{other}", f"{passage[20:]} y", texts[0], texts[0][5:]]
    return texts


@pytest.mark.parametrize("group", [1024, 1])
def test_repeated_bytes(spark, monkeypatch, group):
    """group 1: every group is dealt out again until it is whole windows."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    texts = repeat_texts()
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.removal(docs(spark, texts), length=64, passage=40).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 64)


def test_two_lengths_at_once(spark):
    texts = repeat_texts()
    for length, passage in ((64, 40), (40, 64), (90, 90)):
        for r in suffixes.removal(docs(spark, texts), length, passage, passage_words=0).collect():
            i = r["doc_id"]
            assert tuple(r)[1:5] == brute_repeats(texts, length)[i] and r["passage_bytes"] == brute_repeats(texts, passage)[i][1]


def test_contract_length(spark):
    """400 bytes over whole tables, a very long text and clashing columns included; passages of more than 50 words are told of."""
    rng = random.Random(61)
    long, short = prose(rng, 120, 5000), prose(rng, 55, 5000)
    texts = [f"{prose(rng, 90, 5000)} {long} {prose(rng, 90, 5000)}" for _ in range(3)] + [f"{prose(rng, 90, 5000)} {short} {prose(rng, 9, 5000)}" for _ in range(2)]
    texts += [prose(rng, 20000, 5000), prose(rng, 300, 5000), None, ""]
    texts += [texts[5][:90000] + prose(rng, 10, 5000), texts[6]]
    table = docs(spark, texts).withColumns({"rid": F.lit(1), "sid": F.lit(2), "spans": F.lit(3), "begin": F.lit(4), "n_bytes": F.lit("x")})
    got = {r["doc_id"]: r for r in suffixes.removal(table).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute_repeats(texts, 400)
    assert [got[i]["n_passages"] > 0 for i in range(len(texts))] == [True] * 6 + [True, False, False, True, True] and got[3]["n_removed"] == 0


def test_order_is_sorting():
    rng = random.Random(7)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(120))
        strings = [base[: rng.randrange(121)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 40))]
        groups = np.sort(np.array([rng.randrange(3) for _ in strings]))
        sizes = np.array([len(s) for s in strings])
        rows = suffixes._matrix(np.frombuffer(b"".join(strings) + b" ", np.uint8), np.cumsum(sizes) - sizes, sizes, 1)
        order = suffixes.deep_shallow(rows, sizes, groups, shallow=rng.choice([0, 8, 64]))
        assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings))
        shared = suffixes.neighbours(rows, sizes, groups, order)
        assert shared.tolist() == [suffixes.common(strings[a], strings[b]) if groups[a] == groups[b] else -1 for a, b in zip(order[:-1], order[1:])]


def test_range_minimum_and_nodes():
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 6, 70).astype(np.int32)
    low = rng.integers(0, 69, 200)
    high = low + 1 + rng.integers(0, 70 - low)
    assert suffixes.RangeMinimum(x)(low, high).tolist() == [x[a:b].min() for a, b in zip(low, high)]
    nodes = {(a, b, d) for a, b, d in zip(*(y.tolist() for y in suffixes._nodes(x)))}
    want = set()
    for g in range(len(x)):
        if x[g] >= 0:
            a, b = g, g
            while a > 0 and x[a - 1] >= x[g]:
                a -= 1
            while b + 1 < len(x) and x[b + 1] >= x[g]:
                b += 1
            want.add((a, b + 1, int(x[g])))
    assert nodes == want


def test_long_text_in_steps(monkeypatch):
    """Steps find the anchors, and the bytes around them, that the whole text at once has."""
    rng = random.Random(8)
    texts = [f"{prose(rng, 300)} {prose(rng, 300)}", prose(rng, 100), "short"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array(texts)], names=["rid", "sid", "text"])
    rows = lambda: sorted(tuple(r.values()) for b in suffixes._anchor_rows([64, 100], 16)([batch]) for r in b.to_pylist())
    whole = rows()
    monkeypatch.setattr(suffixes, "STEP", 700)
    assert rows() == whole and {r[0] for r in whole} == {0, 1}


def test_texts_without_repeats(spark):
    texts = repeat_texts()
    table = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("rid", F.lit(2))
    got = {r["doc_id"]: r for r in suffixes.without_repeats(table, length=64).collect()}
    assert suffixes.without_repeats(table, length=64).columns == table.columns and len(got) == len(texts)
    for i, (n, removed, _, _) in enumerate(brute_repeats(texts, 64)):
        assert (got[i]["text"] is None) == (texts[i] is None) and (texts[i] is None or len(got[i]["text"].encode()) <= n - removed)
        assert removed or got[i]["text"] == texts[i]
    assert suffixes.removal(table.limit(0)).count() == 0


# -- MinHash


def brute_groups(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    return [(len(s), top[i], top[i] == i) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(9)
    texts = [prose(rng, 60, 5000) for _ in range(4)]
    for base in texts[:3]:
        for k in range(8):
            w = base.split()
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts + [texts[0].upper(), texts[1] + "  ", "one", "One\n", "two words", "two  words", None, "", "   "]


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_duplicates(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "PART", 2)
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, 3, 85)


def test_one_of_each_group(spark):
    texts = near_texts()
    table = docs(spark, texts + [texts[3]], ids=[*range(len(texts)), 3]).withColumn("key", F.lit(1)).withColumn("_rid", F.lit(2))
    got = sorted(r["doc_id"] for r in minhash.deduplicated(table, 5, 80).collect())
    assert got == [i for i, (_, _, first) in enumerate(brute_groups(texts, 5, 80)) if first]
    assert minhash.deduplicated(table, 5, 80).columns == table.columns
    assert minhash.near_duplicates(table.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (5, 4), (4, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {4: 4, 5: 4}


# -- languages


def test_codes_are_apart():
    for k in (2, 4, 7, 12):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= min(k, 4) // 2


def test_languages(spark):
    rng = random.Random(10)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "keit"], "cc": ["ción", "ado", "ez"]}
    made = [(k, "".join(rng.choice(s) + (" " if rng.random() < 0.4 else "") for _ in range(60))) for _ in range(60) for k, s in syllables.items()]
    table = docs(spark, [t for _, t in made], lang=[k for k, _ in made])
    model = langid.train(table.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, (k, _) in enumerate(made) if i % 2]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, [None, "", "123 !", "é", "ka", "ka"], ids=[0, 1, 2, 3, 4, 5]), model).collect()}
    assert [odd[i] for i in range(3)] == ["und"] * 3 and odd[3] in syllables and odd[4] == odd[5]
    assert langid.train(table.limit(0)) is None and langid.identify(table.limit(1), None).first()["lang_pred"] == "und"


def test_originals_by_join_and_by_broadcast(spark, monkeypatch):
    pages = [(i, f"http://{i}", f"page {i % 7}" if i % 3 else f"own {i}") for i in range(60)] + [(60, None, None), (61, "u", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    columns = ["page_id", "record_type", "refers_to", "refers_url", "payload_digest"]
    few = sorted(map(str, warc.resolve(table).select(columns).collect()))
    monkeypatch.setattr(warc, "FEW", 0)
    assert sorted(map(str, warc.resolve(table).select(columns).collect())) == few
    assert sum("revisit" in r for r in few) == 40 - 7 + 1
