"""What op6 shuffles and makes: texts once for all sizes of groups, a row for each string that holds something repeated."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.llm import suffixes


def _near_copies(n, seed=5):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    return [(i, base[:350] + chr(48 + i) + base[350:]) for i in range(n)]


@pytest.mark.parametrize("group", [4, 4096])
def test_texts_are_cut_once_whatever_the_groups(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    calls, cut = [], suffixes._cut_texts
    monkeypatch.setattr(suffixes, "_cut_texts", lambda: (calls.append(1), cut())[1])
    table = spark.createDataFrame(_near_copies(30), "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in suffixes.removal(table, length=400).collect())
    calls.clear()
    spans = suffixes.covered(table, [64, 100]).collect()
    assert len(calls) == 1
    assert len(spans) == 30
    for r in spans:
        for length in (64, 100):
            assert suffixes._runs(r["spans"], length) == [(0, 350), (351, 701)]


def test_a_string_is_one_row_of_spans(spark):
    table = spark.createDataFrame(_near_copies(40), "doc_id long, text string")
    found = suffixes.repeated_spans(table, [64, 100])
    assert found.columns == ["rid", "sid", "spans"]
    assert found.select(F.max(F.size("spans"))).first()[0] > 1
