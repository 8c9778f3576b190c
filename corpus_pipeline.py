"""From raw documents to packed sequences, in five stages; each takes all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import minhash, mixing, packing, quality, suffixes
from geoloom.llm.common import table, written
from geoloom.llm.queries import TOKENIZER, quality_model

#: Bytes of a passage that counts as repeated: below what 50 words of ordinary prose take (51 one-letter words take 101).
PASSAGE = 200


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is one half or more."""
    return quality.kept(docs, quality_model(spark, sf_dir), at_least=2)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates (five-word shingles, 0.8)."""
    return minhash.deduplicated(docs, words_per_shingle=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a repeated passage covers."""
    return suffixes.without_repeats(docs, length=PASSAGE)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' rates say."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its place."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("mixing sources", mixed_sources),
    ("packing", packed),
]

#: A learned classifier and a tokenizer are no SQL; tests hold the operators against plain versions and the stages to their effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
