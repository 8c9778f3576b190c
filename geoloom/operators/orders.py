"""Orders of all rows of a table, or of each of its groups, without putting a table or a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def _carried(totals: DataFrame, by: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """totals (by and _p, a row each) with values over the parts that a window of Spark sees, for groups of several parts.

    A group lies in neighbouring parts, so all but two parts' first and last groups at most lie in one part alone: what is
    left has two rows a part at most, however many groups there are.
    """
    several = totals.withColumn("_parts", F.count("*").over(Window.partitionBy(*by))).where("_parts > 1") if by else totals
    return several.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_p"), *values)


def _joined(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return rows.join(F.broadcast(offsets), on, "left")


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column] | None = None, by: Sequence[str] = (), keep_part: bool = False) -> DataFrame:
    """df with _rank, the place of each row (from 0), and for each of sums its total over all rows up to this one; by: within each group.

    Rows are dealt out by range of group and order and written with their part; ranks within the parts and the counts of
    the parts before are both read from that table, so a group of very many rows is as many tasks' work as its rows ask
    for. (A range deal that is planned twice may draw its bounds differently.) keep_part: column _part stays, for
    from_here_on.
    """
    sums, by = dict(sums or {}), list(by)
    keys = [F.col(c).asc_nulls_first() for c in by]
    dealt = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*keys, *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    local = Window.partitionBy("_part", *by).orderBy(*order)
    up_to = local.rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(F.col("_part").alias("_p"), *by).agg(F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = _carried(totals, by, [earlier("_n").alias("_n0"), *[earlier(f"_s_{n}").alias(f"_s0_{n}") for n in sums]])
    ranked = dealt.withColumns({"_k": F.row_number().over(local), **{f"_t_{n}": F.sum(f"_v_{n}").over(up_to) for n in sums}})
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [F.col(f"`{c}`") for c in df.columns] + [(F.col("_k") + zero("_n0") - 1).alias("_rank")] + [(zero(f"_t_{n}") + zero(f"_s0_{n}")).alias(n) for n in sums]
    return _joined(ranked, offsets, by).select(*out, *(["_part"] if keep_part else []))


def from_here_on(ranked: DataFrame, value: Column, name: str, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """ranked, from running with keep_part, with the greatest value among a row and all later ones of its group.

    order is the order of running; the greatest value of the later parts of a group is carried to the earlier ones.
    """
    by = list(by)
    held = ranked.withColumn("_v", value)
    backwards = Window.partitionBy("_part", *by).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy(F.col("_part").alias("_p"), *by).agg(F.max("_v").alias("_m"))
    later = Window.partitionBy(*by).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _carried(totals, by, [F.max("_m").over(later).alias("_later")])
    local = held.withColumn("_own", F.max("_v").over(backwards))
    return _joined(local, offsets, by).select(*[F.col(f"`{c}`") for c in ranked.columns], F.greatest("_own", "_later").alias(name))


def quantile(df: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile of a column, interpolated between the two rows around it; None without values. Equal values are counted first, so many ties are one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    up_to = running(counts, [F.col(value).asc()], {"_to": F.col("_n")})
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    at = share * (total - 1)
    if at < 0:
        return None
    low = int(at)
    near = up_to.agg(F.min(F.when(F.col("_to") > low, F.col(value))), F.min(F.when(F.col("_to") > min(low + 1, total - 1), F.col(value)))).first()
    return float(near[0]) + (at - low) * (float(near[1]) - float(near[0]))
