"""Exact percentiles of many groups at once, by histograms that are refined around the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def _magnitude(v: Column) -> Column:
    """A whole number that grows with v and is one for all values of a sign and a power of two; zero, the infinities and NaN have their own."""
    power = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    own = F.when(v > 0, power).when(v < 0, -power).otherwise(0)
    return F.when(F.isnan(v), 5000).when(v == float("inf"), 4000).when(v == float("-inf"), -4000).otherwise(own)


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], steps: int = 4096) -> DataFrame:
    """by, n (values that aren't null), p (array of the percentiles at shares, interpolated as Spark's percentile): a row for each group with a value.

    The first histogram counts sign and power of two, a second one parts the cells in which the wanted ranks lie into steps
    of equal width between the cell's least and greatest value, and so on until each such cell holds one value. Both ends of a cell
    are values, so a round parts it in two at least, and after the first one a cell's values lie within a factor of two, which some five
    rounds of 4096 steps part down to single doubles. A task holds counts of cells, never a group's values; NaN is above all.
    """
    by = list(by)
    data = written(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "values")
    cells = data.groupBy(*by, _magnitude(F.col("_v")).alias("_cell")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at_most = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # a row for each power of two
    cells = written(cells.withColumns({"_to": F.sum("_n").over(at_most), "_all": F.sum("_n").over(Window.partitionBy(*by))}), "cells")
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    ranks = cells.groupBy(*by).agg(F.first("_all").alias("_all")).select(*by, "_all", place.alias("_s")).withColumn("_at", F.col("_s.share") * (F.col("_all") - 1))
    ends = F.explode(F.array(*[F.struct(F.lit(high).alias("high"), f("_at").cast("long").alias("rank")) for high, f in ((False, F.floor), (True, F.ceil))]))
    ranks = ranks.select(*by, "_all", F.col("_s.i").alias("_i"), "_at", ends.alias("_e")).select(*by, "_all", "_i", "_at", "_e.*")

    def same(l: str, r: str, columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in columns], F.lit(True))

    keys = [*by, "_all", "_i", "_at", "high"]
    inside = (F.col("w.rank") >= F.col("c._to") - F.col("c._n")) & (F.col("w.rank") < F.col("c._to"))
    narrowed = lambda wanted, cells, on: wanted.alias("w").join(cells.alias("c"), same("w", "c", on) & inside).select(*[F.col(f"w.{k}") for k in keys], (F.col("w.rank") - F.col("c._to") + F.col("c._n")).alias("rank"), F.col("c._lo"), F.col("c._hi"))
    state, found = written(narrowed(ranks, cells, by), "ranks"), []
    while True:
        found.append(state.where("_lo = _hi"))
        open_ = state.where("_lo <> _hi")
        if open_.isEmpty():
            break
        spans = open_.select(*by, "_lo", "_hi").distinct()
        near = data.alias("d").join(spans.alias("s"), same("d", "s", by) & F.col("d._v").between(F.col("s._lo"), F.col("s._hi")))
        step = F.floor((F.col("d._v") - F.col("s._lo")) / (F.col("s._hi") - F.col("s._lo")) * (steps - 1)).cast("int")
        span = [*by, "_from", "_till"]
        fine = near.select(*[F.col(f"d.{c}") for c in by], F.col("s._lo").alias("_from"), F.col("s._hi").alias("_till"), step.alias("_cell"), "d._v").groupBy(*span, "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        up_to = Window.partitionBy(*span).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # steps rows
        fine = fine.withColumn("_to", F.sum("_n").over(up_to))
        state = written(narrowed(open_.withColumnsRenamed({"_lo": "_from", "_hi": "_till"}), fine, span), "ranks")
    values = reduce(DataFrame.union, [f.select(*keys, F.col("_lo").alias("_v")) for f in found])
    low, high = (F.max(F.when(F.col("high") == h, F.col("_v"))) for h in (False, True))
    part = F.col("_at") - F.floor("_at")
    pairs = values.groupBy(*by, "_all", "_i", "_at").agg(low.alias("_low"), high.alias("_high"))
    one = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_low") + part * F.col("_high"))
    lists = pairs.withColumn("_p", one).groupBy(*by, F.col("_all").alias("n")).agg(F.sort_array(F.collect_list(F.struct("_i", "_p"))).alias("_ps"))  # as long as shares
    return lists.select(*by, "n", F.transform("_ps", lambda s: s["_p"]).alias("p"))
