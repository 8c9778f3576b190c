"""Text as column expressions: tokens, n-grams, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space."""
    return F.transform(_places(words, n), lambda i: F.array_join(F.slice(words, i, n), " "))


def _places(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces, as an array of words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
