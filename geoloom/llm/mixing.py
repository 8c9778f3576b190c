"""Mixing sources to target weights with DataFrame functions only.

Sizes are summed per source, the targets follow from one pass over that small table, and every document is then
emitted floor(rate) times plus one more time with probability rate - floor(rate), decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


#: So many sources, a few hundred KB at most, go to where the texts are.
FEW = 10_000


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(key:seed); the same in every run and on every partition."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    sizes: source, size. Sources take the weights in turn, by code point, null last. The targets share the sum of all
    sizes; a target stops at max_repeat times its source's size, and the excess is shared by weight among the others
    until none is above. With the sources ordered by limit / weight those that stop are a prefix, so running sums give
    the fixed point at once. The windows run over one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    total = F.sum("source_size").over(everything)
    stops = F.col("_limit") * F.col("_weight_left") < (F.col("_total") - F.col("_stopped_before")) * F.col("_weight")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weight.cast("long"))
        .withColumn("_limit", F.col("source_size") * max_repeat)
        .withColumn("_total", total)
        .withColumn("_stopped_before", F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_weight_left", F.sum("_weight").over(after))
        .withColumn("_stops", stops)
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_limit"))).over(everything), F.lit(0)))
        .withColumn("_rest_weight", F.sum(F.when(~F.col("_stops"), F.col("_weight"))).over(everything))
        .withColumn("target", F.when(F.col("_stops"), F.col("_limit").cast("double")).otherwise(F.col("_rest").cast("double") * F.col("_weight") / F.col("_rest_weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def copies(rate: Column, key: Column, seed: int, max_repeat: int) -> Column:
    whole = F.floor(rate)
    return F.least(whole + (unit_hash(key, seed) < rate - whole).cast("long"), F.lit(max_repeat).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: docs' own columns, each document as often as its source's rate and its hash say.

    Needs doc_id, text and source; other columns pass through, whatever their names. A null or empty text has size 0 and
    is emitted like its source's other documents. Rows that repeat a doc_id are decided alike. Empty in, empty out.
    """
    names = docs.columns
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, max_repeat)
    # The document travels as one struct, so that its column names meet no others.
    rates = written(targets.select(F.col("source").alias("_mix_source"), "rate"), "mix-rates")
    if rates.limit(FEW + 1).count() <= FEW:
        rates = F.broadcast(rates)  # else a join that Spark can split by a frequent source's rows
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_mix_doc"))
    joined = rows.join(rates, F.col("_mix_doc.source").eqNullSafe(F.col("_mix_source")))
    n = copies(F.col("rate"), F.col("_mix_doc.doc_id"), seed, max_repeat)
    # array_repeat of nothing is empty, so documents with no copy go without a filter.
    return joined.select("_mix_doc", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select("_mix_doc.*")


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (size times copies)."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, max_repeat).withColumnRenamed("source", "_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed, max_repeat)
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
