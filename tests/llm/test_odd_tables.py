"""The registered queries over tables of nulls, empty and very long texts, ties, repeated rows and clashing names, and over empty ones."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geoloom.llm.queries import QUERIES, TOKENIZER

WORD = r"[^\x20\x09-\x0D]+"
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn int, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Names that the operators use for columns of their own.
CLASHES = {
    "documents": ["rid", "sid", "size", "rate", "target", "taken", "n", "key", "band", "grade", "kept", "component_id", "node", "spans", "begin", "end", "length", "at", "shared", "_doc", "_text", "_rid", "_sid", "_rank", "letters", "u", "v"],
    "labels": ["grade", "text", "lang", "kept"],
    "pages": ["payload", "digest", "record_type", "refers_to", "payload_bytes", "payload_digest", "n", "first", "header"],
    "conversations": ["message", "seq", "kind", "formatted", "events", "loss", "n_turns"],
    "embeddings": ["id", "v", "hash", "cell", "n", "key", "points", "shared", "_n", "score", "rank"],
}
DOCS = [n for n in QUERIES if n.split("_")[0] in ("op2", "op4", "op5", "op6", "op9", "op10")]


def made():
    rng = random.Random(20)
    prose = lambda n, words=3000: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    passage, long = prose(120), prose(40_000)
    texts = [prose(60) for _ in range(20)] + [None, "", " \n", "12 !", "é", long, long + " tail", passage, f"{prose(30)} {passage} {prose(20)}", "x" * 30_000, "one two", "One\ttwo"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", ""][i % 4], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], prose(30), "en", "a", 1), (None, prose(25), "de", "b", 7), (900, texts[2], None, None, None)]
    labels = [(i, [None, 0, 1][i % 3], [0, None, 1][i % 2]) for i in range(30)] + [(None, 1, 0), (4, 1, 0), (4, 0, 0)]
    pages = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c\r\nX: y", None), (4, "", ""), (5, "http://e", "long " * 400_000), (6, "http://e", "long " * 400_000), (7, "http://g", "WARC/1.1\r\n\r\n"), (7, "http://g", "WARC/1.1\r\n\r\n")]
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes " * 300_000 + "</s>"), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "")]
    base = np.random.default_rng(21).normal(size=(30, 6))
    vectors = [(i, (base[i % 30] + 0.05 * (i // 30)).astype("f4").tolist(), [None, 0, 1][i % 3]) for i in range(90)]
    vectors += [(100, None, 0), (101, [0.0] * 6, 0), (102, [None] * 6, 0), (103, [float("nan")] * 6, 1), (104, [], 1), (150, vectors[1][1], 0), (150, vectors[1][1], 0), (200, vectors[1][1], 0)]
    return {"documents": rows, "labels": labels, "pages": pages, "conversations": talks, "embeddings": vectors}


def saved(spark, folder, tables):
    for name, rows in tables.items():
        frame = spark.createDataFrame(rows, SCHEMAS[name])
        frame.select("*", *[F.lit("clash").alias(c) for c in CLASHES[name]]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables():
    return made()


@pytest.fixture(scope="module")
def odd(spark, tables, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("odd"), tables)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(SCHEMAS, []))


def rows_of(spark, name, folder):
    return QUERIES[next(n for n in QUERIES if n.startswith(name + "_"))](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in got] == ([-7] if name.startswith("op1_") else [])


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in DOCS if not n.startswith("op4_")])
def test_a_row_for_each_document(spark, odd, tables, name):
    got = QUERIES[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in tables["documents"])


def test_conversations(spark, odd, tables):
    got = {r["conv_id"]: r for r in rows_of(spark, "op1", odd)}
    talks = {}
    for conv, turn, role, text in sorted(tables["conversations"], key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == {*talks, -7}
    for conv, turns in talks.items():
        own = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), len(own), hashlib.sha256(own.encode()).hexdigest())


def test_pages(spark, odd, tables):
    got = sorted(tuple(r)[:5] for r in rows_of(spark, "op3", odd))
    best = {}
    for page, _, html in tables["pages"]:
        best[html or ""] = max(page, best.get(html or "", page))
    want = []
    for page, _, html in tables["pages"]:
        data = (html or "").encode()
        first = best[html or ""] == page
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pieces(spark, odd, tables):
    own = Tokenizer.from_file(TOKENIZER)
    ids = Counter()
    for r in rows_of(spark, "op4", odd):
        ids[r["doc_id"]] += r["length"]
    want = Counter()
    for doc, text, *_ in tables["documents"]:
        want[doc] += len(own.encode(text or "", add_special_tokens=False).ids) + 1
    assert ids == want


def test_sizes(spark, odd, tables):
    want = sorted(str((d, len(re.findall(WORD, t or "")))) for d, t, *_ in tables["documents"])
    got = rows_of(spark, "op5", odd)
    assert sorted(str((r["doc_id"], r["size"])) for r in got) == want and all(r["taken"] <= 3 * r["size"] for r in got)


def test_removed_bytes(spark, odd, tables):
    data = [(t or "").encode() for _, t, *_ in tables["documents"]]
    seen = Counter(hash(b[i : i + 400]) for b in data for i in range(len(b) - 399))
    want = []
    for (doc, *_), b in zip(tables["documents"], data, strict=True):
        on, end = np.zeros(len(b), bool), 0
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                on[max(i, end) : i + 400] = True
                end = i + 400
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        want.append((doc, len(b), int(on.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~on])).hexdigest()))
    assert sorted(str(tuple(r)[:5]) for r in rows_of(spark, "op6", odd)) == sorted(map(str, want))


def test_best_rows(spark, odd, tables):
    good = sorted({(i, tuple(int(np.floor(x * 256)) for x in v)) for i, v, _ in tables["embeddings"] if v and all(x is not None and np.isfinite(x) for x in v)})
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r)[:4] for r in rows_of(spark, "op7", odd)) == sorted(want)


def test_linked_vectors(spark, odd, tables):
    got = Counter((r["vec_id"], r["n_links"]) for r in rows_of(spark, "op8", odd))
    unit = []
    for _, v, label in tables["embeddings"]:
        x = np.array(v, float) if v and None not in v else np.zeros(1)
        unit.append(x / np.sqrt(x @ x) if label is not None and np.isfinite(x).all() and x @ x else None)
    near = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and tables["embeddings"][i][2] == tables["embeddings"][j][2] and unit[i] @ unit[j] >= 0.93
    assert got == Counter((r[0], sum(near(i, j) for j in range(len(unit)))) for i, r in enumerate(tables["embeddings"]))


def test_components_of_documents(spark, odd, tables):
    rows = [r for r in tables["documents"] if r[0] is not None]
    sets = []
    for _, text, *_ in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    top = [r[0] for r in rows]
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b)]
    for _ in rows:
        for i, j in linked:
            top[i] = top[j] = min(top[i], top[j])
    want = Counter((r[0], len(s), t, t == r[0]) for r, s, t in zip(rows, sets, top, strict=True))
    assert Counter(tuple(r)[:4] for r in rows_of(spark, "op9", odd) if r["doc_id"] is not None) == want


def test_languages_of_odd_texts(spark, odd, tables):
    text = {r[0]: r[1] for r in tables["documents"] if r[0] != 5}
    for r in rows_of(spark, "op10", odd):
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] in text:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""))


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, odd), name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns and at.where("shared <> 'clash'").isEmpty()
    assert at.count() > 0


def test_grades_that_nothing_tells_apart_reject_nothing(spark, odd):
    got = rows_of(spark, "op2", odd)
    assert all(r["kept"] and r["tail"] is None for r in got)
