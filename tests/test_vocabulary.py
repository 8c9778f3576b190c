"""The vocabulary of the reference's size keeps terms that vocab_build's SQL cuts."""

from geoloom.queries import QUERIES


def test_all_terms_of_two_documents(spark, tmp_path):
    words = [f"w{i}" for i in range(3000)]
    texts = [(1, " ".join(words)), (2, " ".join(reversed(words))), (3, "once w7")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["vocab_build_full"](spark, str(tmp_path)).collect()]
    assert got == [("w7", 3, 3), *[(w, 2, 2) for w in sorted(words) if w != "w7"]]


def test_cut_at_100000(spark, tmp_path):
    text = " ".join(f"w{i:06}" for i in range(100_100))
    spark.createDataFrame([(1, text), (2, text), (3, "w100099")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["term"] for r in QUERIES["vocab_build_full"](spark, str(tmp_path)).collect()]
    assert got == ["w100099", *[f"w{i:06}" for i in range(99_999)]]
