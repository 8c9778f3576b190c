"""Evaluation: detection, retrieval, classification, question answering and translation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import evaluation, spatial
from ..scratch import written
from .base import Tables, query

# Detections are boxes, truths suppliers' boxes; a detection is right if it overlaps a truth of its image. Ranked
# predictions come from lineitem: class, score, right or not.

_RANKED = "r AS (SELECT cls % 20 AS cls, score, correct, row_number() OVER (PARTITION BY cls % 20 ORDER BY score DESC, q, n) AS k, sum(correct) OVER (PARTITION BY cls % 20 ORDER BY score DESC, q, n ROWS UNBOUNDED PRECEDING) AS tp, sum(correct) OVER (PARTITION BY cls % 20) AS pos FROM preds)"


def ranked(t: Tables) -> DataFrame:
    """cls, score, correct, k (rank), tp (right ones so far), pos (all right ones)."""
    return evaluation.ranked(t.preds.withColumn("cls", F.col("cls") % 20), "cls", [F.desc("score"), F.col("q"), F.col("n")])


@query(f"WITH {_RANKED} SELECT cls, CAST(k AS BIGINT) AS k, CAST(tp AS BIGINT) AS tp, CAST(k - tp AS BIGINT) AS fp, round(tp / CAST(k AS DOUBLE), 6) AS precision, round(tp / CAST(pos AS DOUBLE), 6) AS recall FROM r WHERE pos > 0")
def precision_recall_curve(t: Tables) -> DataFrame:
    r = ranked(t).where("pos > 0")
    return r.select("cls", F.col("k").cast("long").alias("k"), "tp", (F.col("k") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.col("k"), 6).alias("precision"), F.round(F.col("tp") / F.col("pos"), 6).alias("recall"))


@query(f"""WITH {_RANKED}, e AS (SELECT cls, k, correct, pos, max(tp / CAST(k AS DOUBLE)) OVER (PARTITION BY cls ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS p FROM r WHERE pos > 0)
SELECT cls, round(sum(CASE WHEN correct = 1 THEN p ELSE 0.0 END) / max(pos), 6) AS ap FROM e GROUP BY 1""")
def average_precision(t: Tables) -> DataFrame:
    return evaluation.average_precision(ranked(t), "cls").select("cls", F.round("ap", 6).alias("ap"))


@query(f"""WITH {_RANKED}, e AS (SELECT cls, tp / CAST(pos AS DOUBLE) AS rec, max(tp / CAST(k AS DOUBLE)) OVER (PARTITION BY cls ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS p FROM r WHERE pos > 0),
i AS (SELECT unnest(range(0, 101)) AS i), v AS (SELECT cls, i, max(CASE WHEN rec * 100 >= i - 1e-9 THEN p ELSE 0.0 END) AS p FROM e CROSS JOIN i GROUP BY 1, 2)
SELECT cls, round(sum(p * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1.0 END) / 100, 6) AS ap FROM v GROUP BY 1""")
def average_precision_101(t: Tables) -> DataFrame:
    return evaluation.average_precision_101(ranked(t), "cls").select("cls", F.round("ap", 6).alias("ap"))


@query("""WITH d AS (SELECT b.img, b.id, max(CASE WHEN t.id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM boxes b LEFT JOIN truths t ON t.img = b.img AND t.xmin < b.xmax AND b.xmin < t.xmax AND t.ymin < b.ymax AND b.ymin < t.ymax GROUP BY 1, 2),
i AS (SELECT img, max(hit) AS hit FROM d GROUP BY 1) SELECT round(sum(hit) / CAST(count(*) AS DOUBLE), 6) AS corloc FROM i""")
def corloc(t: Tables) -> DataFrame:
    """Boxes and truths that stand for their cells tell of most images; only images that they don't tell of are looked at in whole."""
    boxes, truths = t.boxes.select("img", *spatial.SIDES), t.truths.select("img", *spatial.SIDES)
    cell = [F.floor(F.col(c) / 16) for c in ("xmin", "ymin")]
    some = lambda d: d.groupBy("img", *cell).agg(F.min(F.struct(*spatial.SIDES)).alias("b")).select("img", "b.*")
    meet = lambda l, r: spatial.box_pairs(l, r, 64, by=["img"]).select("l.img").distinct()
    first = written(meet(some(boxes), some(truths)), "found")
    found = first.union(meet(boxes.join(first, "img", "left_anti"), truths.join(first, "img", "left_anti"))).withColumn("hit", F.lit(1))
    return boxes.select("img").distinct().join(found, "img", "left").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("corloc"))


@query(f"WITH {_RANKED} SELECT cls, round(sum(CASE WHEN k <= 50 THEN correct ELSE 0 END) / CAST(max(pos) AS DOUBLE), 6) AS recall FROM r WHERE pos > 0 GROUP BY 1")
def recall_at_k(t: Tables) -> DataFrame:
    return ranked(t).where("pos > 0").groupBy("cls").agg(F.round(F.sum(F.when(F.col("k") <= 50, F.col("correct")).otherwise(0)) / F.max("pos"), 6).alias("recall"))


@query(f"WITH {_RANKED} SELECT cls, round(quantile_cont(k, 0.5), 6) AS median_rank FROM r WHERE correct = 1 AND k <= 50 GROUP BY 1")
def median_rank_at_k(t: Tables) -> DataFrame:
    return ranked(t).where("correct = 1 and k <= 50").groupBy("cls").agg(F.round(F.percentile("k", 0.5), 6).alias("median_rank"))


_IOU = "CAST(greatest(least(b.xmax, t.xmax) - greatest(b.xmin, t.xmin), 0) * greatest(least(b.ymax, t.ymax) - greatest(b.ymin, t.ymin), 0) AS DOUBLE)"
_PAIRS = f"p AS (SELECT b.img, b.id AS d, t.id AS g, b.score, {_IOU} / ((b.xmax - b.xmin) * (b.ymax - b.ymin) + (t.xmax - t.xmin) * (t.ymax - t.ymin) - {_IOU}) AS iou FROM boxes b JOIN truths t ON t.img = b.img AND t.xmin < b.xmax AND b.xmin < t.xmax AND t.ymin < b.ymax AND b.ymin < t.ymax)"


def overlapping(detections: DataFrame, truths: DataFrame, *columns: str) -> DataFrame:
    """img, d, g, score, iou and columns of detections, of overlapping detections and truths of an image."""
    sides = lambda s: tuple(F.col(f"{s}.{x}") for x in spatial.SIDES)
    pairs = spatial.box_pairs(detections.select("id", "img", "score", *spatial.SIDES, *columns), truths.select("id", "img", *spatial.SIDES), 64, by=["img"])
    return pairs.select(F.col("l.img").alias("img"), F.col("l.id").alias("d"), F.col("r.id").alias("g"), F.col("l.score").alias("score"), geometry.iou(sides("l"), sides("r")).alias("iou"), *[f"l.{c}" for c in columns])


def overlaps(t: Tables) -> DataFrame:
    """img, d, g, score, iou of overlapping detections and truths of an image."""
    return overlapping(spatial.dealt(t.boxes, "id"), spatial.dealt(t.truths, "id"))


@query(f"""WITH {_PAIRS}, b1 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY iou DESC, g) AS n FROM p WHERE iou > 0.1),
m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY iou DESC, d) AS k FROM b1 WHERE n = 1), hit AS (SELECT d, g FROM m WHERE k = 1)
SELECT CASE WHEN h.g IS NULL THEN -1 ELSE h.g % 3 END AS truth, b.id % 3 AS pred, count(*) AS n FROM boxes b LEFT JOIN hit h ON h.d = b.id GROUP BY 1, 2
UNION ALL SELECT t.id % 3, -1, count(*) FROM truths t WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.g = t.id) GROUP BY 1""")
def detection_confusion(t: Tables) -> DataFrame:
    # Pairs are counted down to a number a box where they arise; only those that reach it are ranked.
    best = overlaps(t).where("iou > 0.1").groupBy(F.col("d").alias("id")).agg(F.max("iou").alias("best"))
    near = overlapping(t.boxes.join(best, "id"), t.truths, "best").where("iou = best")
    hit = evaluation.one_to_one(near, "d", "g", [F.desc("iou")]).select("d", "g")
    seen = t.boxes.join(hit, F.col("id") == F.col("d"), "left").select(F.when(F.col("g").isNull(), F.lit(-1)).otherwise(F.col("g") % 3).cast("long").alias("truth"), (F.col("id") % 3).cast("long").alias("pred"))
    missed = t.truths.join(hit, F.col("id") == F.col("g"), "left_anti").select((F.col("id") % 3).cast("long").alias("truth"), F.lit(-1).cast("long").alias("pred"))
    return seen.union(missed).groupBy("truth", "pred").agg(F.count("*").alias("n"))


@query(f"""WITH {_PAIRS} SELECT img, d, g, round(iou, 6) AS iou FROM p WHERE iou > 0.0""")
def box_iou(t: Tables) -> DataFrame:
    return overlaps(t).where("iou > 0").select("img", "d", "g", F.round("iou", 6).alias("iou"))


@query()
def box_iou_match(t: Tables) -> DataFrame:
    return evaluation.match_boxes(t.boxes, t.truths, lambda d, g: overlapping(d, g).where("iou > 0.1"), ["img"])


@query("""WITH b AS (SELECT least(CAST(floor(l_discount * 10 * 20) AS INT), 19) AS bin, l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
g AS (SELECT bin, count(*) AS n, sum(p) AS p, sum(y) AS y FROM b GROUP BY 1) SELECT round(sum(abs(p - y)) / sum(n), 6) AS ece FROM g""")
def calibration_error(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_discount") * 10).cast("double").alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return evaluation.calibration_error(rows, "p", "y", 20).select(F.round("ece", 6).alias("ece"))


@query("""WITH s AS (SELECT correct, row_number() OVER (ORDER BY score DESC, q, n) AS k, sum(correct) OVER (ORDER BY score DESC, q, n ROWS UNBOUNDED PRECEDING) AS tp FROM preds)
SELECT round(sum(correct * tp / CAST(k AS DOUBLE)) / sum(correct), 6) AS gap FROM s""")
def global_average_precision(t: Tables) -> DataFrame:
    return evaluation.global_average_precision(t.preds, ["score", "q", "n"], [False, True, True]).select(F.round("gap", 6).alias("gap"))


@query("""WITH b AS (SELECT q, correct, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS k FROM preds)
SELECT round(avg(CASE WHEN k = 1 THEN CAST(correct AS DOUBLE) END), 6) AS accuracy FROM b""")
def top1_accuracy(t: Tables) -> DataFrame:
    best = t.preds.groupBy("q").agg(F.max_by("correct", F.struct("score", -F.col("n"))).alias("hit"))
    return best.agg(F.round(F.avg("hit"), 6).alias("accuracy"))


@query("""WITH b AS (SELECT q % 100 AS g, q, correct, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS k FROM preds)
SELECT g, round(avg(CASE WHEN k = 1 THEN CAST(correct AS DOUBLE) END), 6) AS hit_at_one FROM b GROUP BY 1""")
def hit_at_one(t: Tables) -> DataFrame:
    best = t.preds.groupBy((F.col("q") % 100).alias("g"), "q").agg(F.max_by("correct", F.struct("score", -F.col("n"))).alias("hit"))
    return best.groupBy("g").agg(F.round(F.avg("hit"), 6).alias("hit_at_one"))


@query("""WITH b AS (SELECT q, correct, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS k, sum(correct) OVER (PARTITION BY q) AS pos FROM preds),
p AS (SELECT q, sum(CASE WHEN k <= pos THEN correct ELSE 0 END) / CAST(max(pos) AS DOUBLE) AS p FROM b WHERE pos > 0 GROUP BY 1) SELECT round(avg(p), 6) AS perr FROM p""")
def precision_at_equal_recall(t: Tables) -> DataFrame:
    r = evaluation.ranked(t.preds, "q", [F.desc("score"), F.col("n")]).where("pos > 0")
    per = r.groupBy("q").agg((F.sum(F.when(F.col("k") <= F.col("pos"), F.col("correct")).otherwise(0)) / F.max("pos")).alias("p"))
    return per.agg(F.round(F.avg("p"), 6).alias("perr"))


@query(f"WITH {_RANKED} SELECT cls, round(sum(correct * tp / CAST(k AS DOUBLE)) / max(pos), 6) AS ap FROM r WHERE pos > 0 GROUP BY 1")
def map_per_class(t: Tables) -> DataFrame:
    return evaluation.plain_ap(ranked(t), "cls").select("cls", F.round("ap", 6).alias("ap"))


@query(f"WITH {_RANKED}, a AS (SELECT cls, sum(correct * tp / CAST(k AS DOUBLE)) / max(pos) AS ap, max(pos) AS pos FROM r WHERE pos > 0 GROUP BY 1) SELECT round(sum(ap * ln(1 + pos)) / sum(ln(1 + pos)), 6) AS weighted_map FROM a")
def log_weighted_map(t: Tables) -> DataFrame:
    a = evaluation.plain_ap(ranked(t), "cls")
    return a.agg(F.round(F.sum(F.col("ap") * F.log1p("pos")) / F.sum(F.log1p("pos")), 6).alias("weighted_map"))


# Retrieval: a query is an order, its answers are parts by score, repeated answers count once; right are returned ones.
_RETR = "f AS (SELECT q, cls % 500 AS id, max(score) AS score, max(correct) AS rel FROM preds GROUP BY 1, 2), s AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k, sum(rel) OVER (PARTITION BY q ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits, sum(rel) OVER (PARTITION BY q) AS pos FROM f)"


def answers(t: Tables) -> DataFrame:
    """q, correct, k, tp, pos of the first occurrence of each answer."""
    first = t.preds.groupBy("q", (F.col("cls") % 500).alias("id")).agg(F.max("score").alias("score"), F.max("correct").alias("correct"))
    return evaluation.ranked(first, "q", [F.desc("score"), F.col("id")])


@query(f"WITH {_RETR}, a AS (SELECT q, sum(CASE WHEN k <= 100 THEN rel * hits / CAST(k AS DOUBLE) END) / least(max(pos), 100) AS ap FROM s WHERE pos > 0 GROUP BY 1) SELECT round(avg(ap), 6) AS retrieval_map FROM a")
def retrieval_map(t: Tables) -> DataFrame:
    a = answers(t).where("pos > 0").groupBy("q").agg((F.sum(F.when(F.col("k") <= 100, F.col("correct") * F.col("tp") / F.col("k"))) / F.least(F.max("pos"), F.lit(100))).alias("ap"))
    return a.agg(F.round(F.avg("ap"), 6).alias("retrieval_map"))


@query(f"""WITH {_RETR}, n AS (SELECT count(DISTINCT q) AS queries FROM s WHERE pos > 0), k AS (SELECT unnest(range(1, 11)) AS k)
SELECT k.k, round(sum(CASE WHEN s.k <= k.k THEN s.rel ELSE 0 END) / CAST(k.k AS DOUBLE) / max(queries), 6) AS mean_precision FROM s CROSS JOIN k CROSS JOIN n WHERE pos > 0 GROUP BY 1""")
def retrieval_precisions(t: Tables) -> DataFrame:
    a = answers(t).where("pos > 0")
    # Right answers counted by rank: ten small rows go on from here.
    by_rank = a.groupBy(F.least(F.col("k"), F.lit(11)).alias("rank")).agg(F.sum("correct").alias("hits"))
    queries = a.agg(F.count_distinct("q").alias("queries"))
    ks = t.spark.range(1, 11).withColumnRenamed("id", "k")
    return ks.join(F.broadcast(by_rank), F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("h")).join(F.broadcast(queries)).select("k", F.round(F.col("h") / F.col("k") / F.col("queries"), 6).alias("mean_precision"))


@query(f"WITH {_RETR}, m AS (SELECT q, coalesce(min(CASE WHEN rel = 1 AND k <= 100 THEN k END), 101) AS pos FROM s GROUP BY 1) SELECT round(avg(pos), 6) AS mean_position, round(quantile_cont(pos, 0.5), 6) AS median_position FROM m")
def retrieval_positions(t: Tables) -> DataFrame:
    m = answers(t).groupBy("q").agg(F.coalesce(F.min(F.when((F.col("correct") == 1) & (F.col("k") <= 100), F.col("k"))), F.lit(101)).alias("pos"))
    return m.agg(F.round(F.avg("pos"), 6).alias("mean_position"), F.round(F.percentile("pos", 0.5), 6).alias("median_position"))


@query("""WITH c AS (SELECT q, score, n, max(CASE WHEN n = 1 THEN score END) OVER (PARTITION BY q) AS own FROM preds), p AS (SELECT q, count(*) FILTER (WHERE score > own) AS pos FROM c GROUP BY 1)
SELECT round(avg(CASE WHEN pos < 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN pos < 3 THEN ln(2) / ln(pos + 2) ELSE 0.0 END), 6) AS ndcg FROM p""")
def hit_rate_ndcg(t: Tables) -> DataFrame:
    own = t.preds.where("n = 1").groupBy(F.col("q").alias("_q")).agg(F.max("score").alias("own"))
    p = t.preds.join(own, F.col("q") == F.col("_q"), "left").groupBy("q").agg(F.count_if(F.col("score") > F.col("own")).alias("pos"))
    hit = F.col("pos") < 3
    return p.agg(F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.when(hit, F.log(F.lit(2.0)) / F.log(F.col("pos") + 2)).otherwise(0.0)), 6).alias("ndcg"))


# Texts: a conversation's answers are held against its questions.
_TURNS = "a AS (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS ref, a.text AS hyp FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: x <> '')"


def exchanges(t: Tables) -> DataFrame:
    """id, ref, hyp: what the user said and the answer."""
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "ref", "hyp")


def _ngram_sql(n: int, side: str) -> str:
    return f"SELECT id, {n} AS n, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT id, {_TOK.format(side)} AS w FROM a)"


_BLEU = " UNION ALL ".join(f"({_ngram_sql(n, 'ref')})" for n in range(1, 5)), " UNION ALL ".join(f"({_ngram_sql(n, 'hyp')})" for n in range(1, 5))


@query(f"""WITH {_TURNS}, rg AS (SELECT id, n, g, count(*) AS c FROM ({_BLEU[0]}) GROUP BY 1, 2, 3), hg AS (SELECT id, n, g, count(*) AS c FROM ({_BLEU[1]}) GROUP BY 1, 2, 3),
s AS (SELECT hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS hit, sum(hg.c) AS total FROM hg LEFT JOIN rg ON rg.id = hg.id AND rg.n = hg.n AND rg.g = hg.g GROUP BY 1),
p AS (SELECT n, hit, total, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS zeros FROM s),
l AS (SELECT sum(len({_TOK.format('ref')})) AS r, sum(len({_TOK.format('hyp')})) AS h FROM a)
SELECT round(exp(avg(ln(CASE WHEN hit > 0 THEN CAST(hit AS DOUBLE) / total ELSE 1.0 / (power(2, zeros) * total) END))) * max(CASE WHEN h >= r THEN 1.0 ELSE exp(1 - CAST(r AS DOUBLE) / h) END), 8) AS bleu FROM p CROSS JOIN l""")
def bleu(t: Tables) -> DataFrame:
    return evaluation.bleu(exchanges(t), "id", "ref", "hyp").select(F.round("bleu", 8).alias("bleu"))


_NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH {_TURNS}, w AS (SELECT id, {_NORM.format('ref')} AS r, {_NORM.format('hyp')} AS h FROM a),
rc AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(r) AS g FROM w) GROUP BY 1, 2), hc AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(h) AS g FROM w) GROUP BY 1, 2),
o AS (SELECT rc.id, sum(least(rc.c, hc.c)) AS inter FROM rc JOIN hc ON hc.id = rc.id AND hc.g = rc.g GROUP BY 1)
SELECT w.id, CASE WHEN r = h THEN 1 ELSE 0 END AS exact, round(coalesce(2.0 * inter / (len(r) + len(h)), 0.0), 6) AS f1 FROM w LEFT JOIN o ON o.id = w.id""")
def qa_exact_f1(t: Tables) -> DataFrame:
    return evaluation.qa_scores(exchanges(t), "id", "ref", "hyp").select("id", "exact", F.round("f1", 6).alias("f1"))


@query(f"""WITH {_TURNS}, w AS (SELECT id // 1000 AS q, id, {_NORM.format('ref')} AS r, {_NORM.format('hyp')} AS h FROM a),
rc AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(r) AS g FROM w) GROUP BY 1, 2), hc AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(h) AS g FROM w) GROUP BY 1, 2),
o AS (SELECT rc.id, sum(least(rc.c, hc.c)) AS inter FROM rc JOIN hc ON hc.id = rc.id AND hc.g = rc.g GROUP BY 1),
s AS (SELECT q, max(CASE WHEN r = h THEN 1 ELSE 0 END) AS exact, max(coalesce(2.0 * inter / (len(r) + len(h)), 0.0)) AS f1 FROM w LEFT JOIN o ON o.id = w.id GROUP BY 1),
k AS (SELECT DISTINCT conv_id AS q FROM conversations)
SELECT count(*) AS questions, round(100.0 * sum(coalesce(exact, 0)) / count(*), 6) AS exact, round(100.0 * sum(coalesce(f1, 0.0)) / count(*), 6) AS f1 FROM k LEFT JOIN s ON s.q = k.q""")
def qa_alias_scores(t: Tables) -> DataFrame:
    scores = evaluation.qa_scores(exchanges(t), "id", "ref", "hyp").groupBy(F.floor(F.col("id") / 1000).alias("q")).agg(F.max("exact").alias("exact"), F.max("f1").alias("f1"))
    asked = t.conversations.select(F.col("conv_id").alias("q")).distinct()
    return asked.join(scores, "q", "left").fillna(0).agg(F.count("*").alias("questions"), F.round(100.0 * F.sum("exact") / F.count("*"), 6).alias("exact"), F.round(100.0 * F.sum("f1") / F.count("*"), 6).alias("f1"))


@query(f"""WITH {_TURNS}, rg AS (SELECT id, g, count(*) AS c FROM ({_ngram_sql(2, 'ref')}) GROUP BY 1, 2), hg AS (SELECT id, g, count(*) AS c FROM ({_ngram_sql(2, 'hyp')}) GROUP BY 1, 2),
o AS (SELECT rg.id, count(*) AS inter FROM rg JOIN hg ON hg.id = rg.id AND hg.g = rg.g GROUP BY 1),
n AS (SELECT a.id, (SELECT count(*) FROM rg WHERE rg.id = a.id) AS r, (SELECT count(*) FROM hg WHERE hg.id = a.id) AS h FROM a)
SELECT round(avg(coalesce(2.0 * inter / nullif(r + h, 0), 0.0)), 6) AS rouge_2 FROM n LEFT JOIN o ON o.id = n.id""")
def rouge_2(t: Tables) -> DataFrame:
    return evaluation.rouge_n(exchanges(t), "id", "ref", "hyp", 2).agg(F.round(F.avg("f1"), 6).alias("rouge_2"))


@query()
def rouge_l(t: Tables) -> DataFrame:
    return evaluation.rouge_l(exchanges(t), "id", "ref", "hyp").agg(F.round(F.avg("f1"), 6).alias("rouge_l"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount AS na, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE -0.01 END AS gain FROM lineitem),
g AS (SELECT na, sum(CAST(gain AS DOUBLE)) AS gain FROM s GROUP BY 1), c AS (SELECT na, sum(gain) OVER (ORDER BY na ROWS UNBOUNDED PRECEDING) AS total FROM g)
SELECT round(na, 6) AS threshold, round(total, 4) AS gain FROM c ORDER BY round(total, 4) DESC, na LIMIT 1""")
def qa_best_threshold(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_discount").alias("na"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(F.lit(-0.01)).cast("double").alias("gain"))
    return evaluation.best_threshold(rows, "na", "gain").select(F.round("na", 6).alias("threshold"), F.round("total", 4).alias("gain"))


