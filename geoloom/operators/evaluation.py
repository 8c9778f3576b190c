"""Evaluation measures over tables of ranked predictions, matches and texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import written
from . import spatial
from .orders import from_here_on, running
from .rings import once


def ranked(predictions: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """predictions (correct 0/1) with k (rank within by), tp (right ones up to it), pos (all right ones), and _part and _rank (see orders.running). A class of very many predictions is many tasks' work."""
    r = running(predictions, order, {"tp": F.col("correct")}, by=[by], keep_part=True).withColumn("k", (F.col("_rank") + 1).cast("int"))
    pos = predictions.groupBy(F.col(by).alias("_class")).agg(F.sum("correct").alias("pos"))
    return r.join(pos, F.col(by).eqNullSafe(F.col("_class")), "left").drop("_class")


def _envelope(r: DataFrame, by: str) -> DataFrame:
    """The rows of classes with right predictions, with _p, the best precision from there on."""
    return from_here_on(r.where("pos > 0"), F.col("tp") / F.col("k"), "_p", [by], [F.col("k")])


def average_precision(r: DataFrame, by: str) -> DataFrame:
    """by, ap: every recall step at the best precision from there on."""
    return _envelope(r, by).groupBy(by).agg((F.sum(F.when(F.col("correct") == 1, F.col("_p")).otherwise(0.0)) / F.max("pos")).alias("ap"))


def average_precision_101(r: DataFrame, by: str) -> DataFrame:
    """by, ap: the envelope at recalls 0, 0.01, ..., 1, by the trapezoid rule. A row goes to the recalls it is the first to reach."""
    step = lambda tp: F.floor(tp * 100.0 / F.col("pos") + 1e-9).cast("int")
    hits = _envelope(r, by).where("correct = 1")
    first = F.when(F.col("tp") == 1, 0).otherwise(step(F.col("tp") - 1) + 1)
    reached = hits.withColumns({"_a": first, "_b": step(F.col("tp"))}).where("_a <= _b").select(by, "_p", F.explode(F.sequence("_a", "_b")).alias("i"))
    weight = F.when(F.col("i").isin(0, 100), 0.5).otherwise(1.0)
    return reached.groupBy(by).agg((F.sum(F.col("_p") * weight) / 100).alias("ap"))


def plain_ap(r: DataFrame, by: str) -> DataFrame:
    """by, ap, pos: the mean precision at right predictions."""
    return r.where("pos > 0").groupBy(by).agg((F.sum(F.col("correct") * F.col("tp") / F.col("k")) / F.max("pos")).alias("ap"), F.max("pos").alias("pos"))


def global_average_precision(predictions: DataFrame, order: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """gap over one order of all rows, without putting them in one task."""
    keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(order, ascending, strict=True)]
    at = running(predictions.select(*order, "correct"), keys, {"_tp": F.col("correct")})
    return at.agg((F.sum(F.col("correct") * F.col("_tp") / (F.col("_rank") + 1)) / F.sum("correct")).alias("gap"))


def one_to_one(pairs: DataFrame, left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """The best pair of each left, then the best of those of each right."""
    a = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(left).orderBy(*order, right))).where("_n = 1")
    return a.withColumn("_n", F.row_number().over(Window.partitionBy(right).orderBy(*order, left))).where("_n = 1").drop("_n")


def greedy_match(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """d, g, iou by score: each detection, best score first (then least d), takes the unused truth it overlaps most.

    pairs: d, g, score, iou and the columns of by, within which d and g are matched. Greedy order without a global one: in
    each round the pairs that come first both for their detection and for their truth are taken, and the other pairs of
    these go; rounds go on until no pair is left, and their number is the longest chain of pairs that wait for each other.
    """
    order = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"), "d", (-F.col("iou")).alias("o"), "g", "iou")
    left = written(pairs.select(*by, F.col("d").cast("long").alias("d"), F.col("g").cast("long").alias("g"), "score", F.col("iou").cast("double").alias("iou")), "match-pairs")
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in by]
    found = []
    while not left.isEmpty():
        first = lambda side: left.groupBy(*by, side).agg(F.min(order).alias("best")).select(*by, "best.d", "best.g", "best.iou").alias(side)  # noqa: B023, E731
        both = first("d").join(first("g"), [*same("d", "g"), F.col("d.d") == F.col("g.d"), F.col("d.g") == F.col("g.g")])
        found.append(written(both.select("d.*"), "matched"))
        rest = left.alias("l")
        for side in ("d", "g"):
            rest = rest.join(found[-1].alias("f"), [*same("l", "f"), F.col(f"l.{side}") == F.col(f"f.{side}")], "left_anti").alias("l")
        left = written(rest, "match-pairs")
    out = reduce(DataFrame.union, found) if found else left
    return out.select("d", "g", "iou")


#: Detections of the first lot, and pairs of a lot that tasks settle, one for each group of by; more take rounds of joins.
_FIRST, _SETTLED = 5_000, 3_000_000


def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """greedy_match of one group: from the first pair on, a pair is taken if its detection and its truth are free."""
    score = pairs["score"].to_numpy(float)
    order = np.lexsort((pairs["g"], -pairs["iou"].to_numpy(float), pairs["d"], -score, pairs["none"]))
    (ds, d), (gs, g) = (np.unique(pairs[c].to_numpy()[order], return_inverse=True) for c in "dg")
    used_d, used_g, taken = bytearray(len(ds)), bytearray(len(gs)), []
    for i in range(0, len(order), 1 << 16):  # numbers of Python take ten times the room
        for k, (a, b) in enumerate(zip(d[i : i + (1 << 16)].tolist(), g[i : i + (1 << 16)].tolist(), strict=True), i):
            if not used_d[a] and not used_g[b]:
                used_d[a] = used_g[b] = 1
                taken.append(k)
    return pairs.iloc[order[taken]][["d", "g", "iou"]]


def _matched(pairs: DataFrame, by: Sequence[str], met: int) -> DataFrame:
    """greedy_match of a lot of met pairs. Few are settled in tasks, if doubles tell the scores apart."""
    kind = pairs.schema["score"].dataType
    exact = kind.typeName() in ("double", "float", "integer", "short", "byte") or (kind.typeName() == "decimal" and kind.precision <= 15)
    if met > _SETTLED or not exact:
        return greedy_match(pairs, by)
    rows = pairs.select(*by, F.col("d").cast("long").alias("d"), F.col("g").cast("long").alias("g"), F.col("score").cast("double").alias("score"), F.col("score").isNull().alias("none"), F.col("iou").cast("double").alias("iou"))
    return rows.groupBy(*by).applyInPandas(_settled, "d long, g long, iou double")


def match_boxes(detections: DataFrame, truths: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame], by: Sequence[str]) -> DataFrame:
    """greedy_match of the pairs (see there) that the function pairs gives for detections (id, score) and truths (id).

    Detections are matched from the best scores on, lot by lot; a lot meets only truths that are still unused, and those are
    few soon where there are many detections for each. A lot has about as many pairs as tasks settle at once: its
    detections grow as truths go. Equal scores stay in one lot.
    """
    order = (-F.col("score")).alias("_order")  # ascending; NaN comes after all numbers, as in the match
    left, unused = written(detections.select("*", order), "detections"), written(truths, "truths")
    n, lot, found = left.count(), _FIRST, []
    while True:
        cut = left.agg(F.percentile_approx("_order", lot / n, 10_000)).first()[0] if n > lot else None  # one number
        cut = None if cut is None or cut != cut else cut
        head = left if cut is None else left.where(F.col("_order") <= cut)
        met = written(pairs(head.drop("_order"), unused).select(*by, "d", "g", "score", "iou"), "match-pairs")
        count = met.count()
        found.append(written(_matched(met, by, count), "matches"))
        if cut is None:
            return reduce(DataFrame.union, found)
        unused = written(unused.join(found[-1].select(F.col("g").alias("id")), "id", "left_anti"), "truths")
        left = left.where((F.col("_order") > cut) | F.col("_order").isNull())
        n, lot = left.count(), max(1, int(lot * min(max(_SETTLED / 2 / max(count, 1), 1 / 4), 8)))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """ece: mean distance of predicted and true share over equal bins, weighted by size."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("_b")).agg(F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"))
    return g.agg((F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"))


def best_threshold(rows: DataFrame, key: str, gain: str) -> DataFrame:
    """key, total: where the sum of gains of rows at or below is largest (the least key of equals). Sums run over the distinct keys."""
    g = rows.groupBy(key).agg(F.sum(gain).alias("_g"))
    c = running(g, [F.col(key).asc()], {"total": F.col("_g")}).select(key, "total")
    return c.orderBy(F.desc(F.round("total", 4)), key).limit(1)


def _grams(pairs: DataFrame, key: str, side: str, sizes: Sequence[int]) -> DataFrame:
    words = pairs.select(key, text.tokens(F.col(side)).alias("_w"))
    sized = lambda n: F.transform(text.ngrams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    grams = F.explode(F.flatten(F.array(*[sized(n) for n in sizes])))
    return words.select(key, grams.alias("_g")).groupBy(key, "_g.n", "_g.g").agg(F.count("*").alias("c"))


def bleu(pairs: DataFrame, key: str, ref: str, hyp: str, most: int = 4) -> DataFrame:
    """Corpus BLEU of one reference each: clipped precisions of 1..most words, halved ever again where none fits, and the brevity penalty."""
    sizes = range(1, most + 1)
    r, h = _grams(pairs, key, ref, sizes).withColumnRenamed("c", "_r"), _grams(pairs, key, hyp, sizes)
    s = h.join(r, [key, "n", "g"], "left").groupBy("n").agg(F.sum(F.least("c", F.coalesce("_r", F.lit(0)))).alias("hit"), F.sum("c").alias("total"))
    zeros = F.sum((F.col("hit") == 0).cast("int")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))  # most rows
    p = s.withColumn("p", F.when(F.col("hit") > 0, F.col("hit") / F.col("total")).otherwise(1.0 / (F.pow(F.lit(2.0), zeros) * F.col("total"))))
    size = pairs.agg(F.sum(F.size(text.tokens(F.col(ref)))).alias("_lr"), F.sum(F.size(text.tokens(F.col(hyp)))).alias("_lh"))
    short = F.when(F.col("_lh") >= F.col("_lr"), 1.0).otherwise(F.exp(1 - F.col("_lr") / F.col("_lh")))
    return p.agg(F.exp(F.avg(F.log("p"))).alias("_m")).join(F.broadcast(size)).select((F.col("_m") * short).alias("bleu"))


def qa_scores(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """key, exact, f1 of normalized answers; f1 counts words as often as both have them."""
    w = pairs.select(key, text.normal_answer(F.col(ref)).alias("r"), text.normal_answer(F.col(hyp)).alias("h"))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    both = F.aggregate(F.array_distinct("r"), F.lit(0), lambda s, x: s + F.least(times(F.col("r"), x), times(F.col("h"), x)))
    return w.select(key, (F.col("r") == F.col("h")).cast("int").alias("exact"), F.coalesce(F.try_divide(2.0 * both, (F.size("r") + F.size("h")).cast("double")), F.lit(0.0)).alias("f1"))


def rouge_n(pairs: DataFrame, key: str, ref: str, hyp: str, n: int) -> DataFrame:
    """key, f1 of the sets of runs of n words."""
    # Words are made once a text: within a run's expression Spark would make them again for every run.
    words = once(spatial.dealt(pairs.select(key, ref, hyp), key), _r=text.tokens(F.col(ref)), _h=text.tokens(F.col(hyp)))
    grams = lambda c: F.array_distinct(text.ngrams(F.col(c), n))
    w = once(words.select(key, "_r", "_h"), r=grams("_r"), h=grams("_h"))
    return w.select(key, F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect("r", "h")), (F.size("r") + F.size("h")).cast("double")), F.lit(0.0)).alias("f1"))


def rouge_l(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """key, f1 of the longest common subsequence of words: a row of the table at a time, in a pandas UDF."""

    @F.pandas_udf("double")
    def score(r: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(r, h, strict=True):
            if not len(a) or not len(b):
                out.append(0.0)
                continue
            b, row = np.asarray(b, object), np.zeros(len(b) + 1, int)
            for x in a:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
            out.append(2.0 * row[-1] / (len(a) + len(b)))
        return pd.Series(out)

    return pairs.select(key, score(text.tokens(F.col(ref)), text.tokens(F.col(hyp))).alias("f1"))
