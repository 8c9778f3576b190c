"""The five stages on a small corpus, and the guard that lets the rest live without them."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from geoloom.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ing", "es"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    good = [text(120) for _ in range(40)] + [f"{text(60)} {passage} {text(60)}" for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(good + [good[0], good[1] + " " + word()])]
    rows += [(100 + i, " ".join(f"{w}###" for w in text(80).split())) for i in range(40)] + [(200 + i, text(80) + " zounds") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 200 else 1, 1 if i >= 200 else 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
        at.write.parquet(out := f"{tmp_path}/{name}")
        at = spark.read.parquet(out)
        kept.append(at)
    graded = {r["doc_id"] for r in kept[0].collect()}
    assert len({i for i in graded if i < 100}) >= 43 and len({i for i in graded if i >= 100}) <= 4
    alone = {r["doc_id"] for r in kept[1].collect()}
    assert 43 not in alone and 44 not in alone and alone <= graded
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert set(texts) == alone and all(passage[20:-20] not in t for t in texts.values())
    assert all(texts[i] == good[i] for i in range(2, 40) if i in alone)
    assert {r["doc_id"] for r in kept[3].collect()} <= alone
    assert {r["doc_id"] for r in kept[4].collect()} == {r["doc_id"] for r in kept[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_the_rest_lives_without(tmp_path):
    for p in ("geoloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    (tmp_path / "geoloom/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
