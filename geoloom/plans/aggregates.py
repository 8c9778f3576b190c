"""Zonal and raster statistics, vocabularies and rating counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import NDVI_LEGEND, interval
from ..operators import raster, spatial
from ..operators.orders import running
from ..operators.quantiles import percentiles
from ..operators.rings import once
from .base import Tables, query

#: Hectares of a ten-metre cell.
CELL_HA = 0.01


def in_zones(t: Tables, cells: DataFrame) -> DataFrame:
    """cells (r, c, ...) with the zone that holds each."""
    return spatial.points_in_boxes(cells, "c", "r", t.zones, 20)


_IN = "JOIN zones z ON c >= z.xmin AND c < z.xmax AND r >= z.ymin AND r < z.ymax"


@query(f"SELECT zone, cls, count(*) * 100 AS area_m2 FROM cls_before {_IN} GROUP BY 1, 2")
def zonal_class_area(t: Tables) -> DataFrame:
    return in_zones(t, t.cls_before).groupBy("zone", "cls").agg((F.count("*") * 100).alias("area_m2"))


@query(f"""WITH a AS (SELECT zone, cls, count(*) AS n FROM cls_before {_IN} GROUP BY 1, 2), l AS (SELECT unnest([1, 2, 3, 4]) AS cls)
SELECT z.zone, l.cls, coalesce(n, 0) * 100 AS area_m2 FROM zones z CROSS JOIN l LEFT JOIN a ON a.zone = z.zone AND a.cls = l.cls""")
def zonal_class_area_dense(t: Tables) -> DataFrame:
    legend = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("cls")
    return t.zones.select("zone", legend).join(zonal_class_area(t), ["zone", "cls"], "left").fillna(0, ["area_m2"])


@query(f"""SELECT zone, CAST(count(*) FILTER (WHERE cls = 1) AS BIGINT) AS green, CAST(count(*) FILTER (WHERE cls = 2) AS BIGINT) AS water, CAST(count(*) FILTER (WHERE cls = 3) AS BIGINT) AS built FROM cls_before {_IN} GROUP BY 1""")
def zonal_pivot(t: Tables) -> DataFrame:
    wide = in_zones(t, t.cls_before).groupBy("zone").pivot("cls", [1, 2, 3]).count().fillna(0)
    return wide.select("zone", F.col("1").alias("green"), F.col("2").alias("water"), F.col("3").alias("built"))


@query("SELECT scene_id, b2 % 4 AS cls, round(count(*) * 0.01, 6) AS ha FROM px GROUP BY 1, 2")
def class_area_total(t: Tables) -> DataFrame:
    return t.px.groupBy("scene_id", (F.col("b2") % 4).alias("cls")).agg(F.round(F.count("*") * CELL_HA, 6).alias("ha"))


@query(f"""WITH w AS (SELECT zone, count(*) FILTER (WHERE cls = 1) AS green, count(*) FILTER (WHERE cls = 2) AS water FROM cls_before {_IN} GROUP BY 1)
SELECT zone, 'green' AS class, green AS area FROM w UNION ALL SELECT zone, 'water', water FROM w""")
def unpivot_stats(t: Tables) -> DataFrame:
    return zonal_pivot(t).select("zone", "green", "water").unpivot(["zone"], ["green", "water"], "class", "area")


@query(f"SELECT zone, round(quantile_cont(b1, 0.5), 6) AS height FROM px {_IN} WHERE b1 <> 1 GROUP BY 1")
def zonal_median(t: Tables) -> DataFrame:
    return percentiles(in_zones(t, t.px.where("b1 <> 1")), ["zone"], "b1", [0.5]).select("zone", F.round(F.col("p")[0], 6).alias("height"))


@query("""WITH l AS (SELECT scene_id, 'b1' AS band, b1 AS v FROM px UNION ALL SELECT scene_id, 'b2', b2 FROM px)
SELECT scene_id, band, min(v) AS vmin, max(v) AS vmax, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p98 FROM l WHERE v <> 0 GROUP BY 1, 2""")
def band_statistics(t: Tables) -> DataFrame:
    v, data = F.col("value"), raster.long_bands(t.px, ["b1", "b2"]).where("value <> 0")
    sums = data.groupBy("scene_id", "band").agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))
    p = percentiles(data, ["scene_id", "band"], "value", [0.02, 0.98])
    return sums.join(p, ["scene_id", "band"]).select(*sums.columns, F.round(F.col("p")[0], 6).alias("p2"), F.round(F.col("p")[1], 6).alias("p98"))


@query("""WITH l AS (SELECT scene_id, 'b1' AS band, b1 AS v FROM px UNION ALL SELECT scene_id, 'b2', b2 FROM px), m AS (SELECT scene_id, band, avg(v) AS m FROM l GROUP BY 1, 2)
SELECT band, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM m GROUP BY 1""")
def dataset_band_mean(t: Tables) -> DataFrame:
    means = raster.long_bands(t.px, ["b1", "b2"]).groupBy("scene_id", "band").agg(F.avg("value").alias("m"))
    return means.groupBy("band").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"))


@query("SELECT min(b1) AS b1_min, max(b1) AS b1_max, min(b2) AS b2_min, max(b2) AS b2_max FROM px")
def dataset_min_max(t: Tables) -> DataFrame:
    return t.px.agg(*[f(b).alias(f"{b}_{n}") for b in ("b1", "b2") for f, n in ((F.min, "min"), (F.max, "max"))])


@query("""WITH m AS (SELECT scene_id, min(b1) AS lo, max(b1) AS hi FROM px WHERE b1 <> 0 GROUP BY 1)
SELECT px.scene_id, CAST(least(floor((b1 - lo) * 100.0 / nullif(hi - lo, 0)), 99) AS BIGINT) AS bin, count(*) AS n FROM px JOIN m ON m.scene_id = px.scene_id WHERE b1 <> 0 GROUP BY 1, 2""")
def band_histogram(t: Tables) -> DataFrame:
    data = t.px.where("b1 <> 0")
    m = data.groupBy("scene_id").agg(F.min("b1").alias("lo"), F.max("b1").alias("hi"))
    bin_ = F.least(F.floor((F.col("b1") - F.col("lo")) * 100.0 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(99).cast("long"))
    return data.join(m, "scene_id").groupBy("scene_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT scene_id, b2 AS value FROM px")
def unique_values(t: Tables) -> DataFrame:
    return t.px.select("scene_id", F.col("b2").alias("value")).distinct()


@query("""WITH q AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS qs,
  quantile_cont(l_extendedprice, [0.001, 0.022, 0.158, 0.5, 0.842, 0.978, 0.999]) AS ss FROM lineitem),
i AS (SELECT unnest(range(1, 7)) AS i)
SELECT 'equal' AS kind, i, round(lo + (hi - lo) * (i - 1) / 5.0, 4) AS low, round(lo + (hi - lo) * i / 5.0, 4) AS high FROM q CROSS JOIN i WHERE i <= 5
UNION ALL SELECT 'quantile', i, round(qs[i], 4), round(qs[i + 1], 4) FROM q CROSS JOIN i WHERE i <= 5
UNION ALL SELECT 'standard', i, round(ss[i], 4), round(CASE WHEN i = 6 THEN hi ELSE ss[i + 1] END, 4) FROM q CROSS JOIN i""")
def class_breaks(t: Tables) -> DataFrame:
    shares = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 0.001, 0.022, 0.158, 0.5, 0.842, 0.978, 0.999]
    p = percentiles(t.lineitem, [], "l_extendedprice", shares)
    q = p.select(F.col("p")[0].alias("lo"), F.col("p")[5].alias("hi"), F.slice("p", 1, 6).alias("qs"), F.slice("p", 7, 7).alias("ss"))
    rows = q.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("i"))
    i = F.col("i")
    at = lambda a, k: F.try_element_at(F.col(a), k.cast("int"))
    part = lambda kind, low, high, last: rows.where(i <= last).select(F.lit(kind).alias("kind"), "i", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))
    step = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / 5.0
    return part("equal", step(i - 1), step(i), 5).union(part("quantile", at("qs", i), at("qs", i + 1), 5)).union(part("standard", at("ss", i), F.when(i == 6, F.col("hi")).otherwise(at("ss", i + 1)), 6))


_NDVI = "(b4 - b3) / nullif(CAST(b4 + b3 AS DOUBLE), 0)"


@query(f"""WITH v AS (SELECT scene_id, {_NDVI} AS v FROM px4),
k AS (SELECT scene_id, CASE WHEN v > 0.8 THEN 5 WHEN v > 0.6 THEN 4 WHEN v > 0.4 THEN 3 WHEN v > 0.2 THEN 2 WHEN v > 0.0 THEN 1 END AS class FROM v)
SELECT scene_id, class, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY scene_id) AS DOUBLE), 6) AS share FROM k WHERE class IS NOT NULL GROUP BY 1, 2""")
def index_class_distribution(t: Tables) -> DataFrame:
    v = F.try_divide((F.col("b4") - F.col("b3")).cast("double"), (F.col("b4") + F.col("b3")).cast("double"))
    n = t.px4.select("scene_id", interval(v, tuple(x for x, _ in NDVI_LEGEND)).alias("class")).where("class is not null").groupBy("scene_id", "class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scene_id")), 6))


@query(f"SELECT zone, round(avg({_NDVI}), 6) AS mean_index, count(*) * 100 AS area_m2 FROM px4 {_IN} GROUP BY 1")
def zone_index_stats(t: Tables) -> DataFrame:
    v = F.try_divide((F.col("b4") - F.col("b3")).cast("double"), (F.col("b4") + F.col("b3")).cast("double"))
    return in_zones(t, t.px4).groupBy("zone").agg(F.round(F.avg(v), 6).alias("mean_index"), (F.count("*") * 100).alias("area_m2")).orderBy("mean_index")


@query(f"SELECT zone, cls, count(*) * 100 AS area_m2 FROM cls_before {_IN} GROUP BY ROLLUP (zone, cls)")
def zonal_area_rollup(t: Tables) -> DataFrame:
    return in_zones(t, t.cls_before).rollup("zone", "cls").agg((F.count("*") * 100).alias("area_m2"))


_CONF = "SELECT b.cls AS truth, a.cls AS pred, count(*) AS n FROM cls_before b JOIN cls_after a ON a.r = b.r AND a.c = b.c GROUP BY 1, 2"


def confusion(t: Tables) -> DataFrame:
    both = t.cls_before.withColumnRenamed("cls", "truth").join(t.cls_after.withColumnRenamed("cls", "pred"), ["r", "c"])
    return both.groupBy("truth", "pred").agg(F.count("*").alias("n"))


@query(f"""WITH m AS ({_CONF}), s AS (SELECT sum(n) AS n, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM m),
e AS (SELECT sum(t.n * p.n) AS e FROM (SELECT truth AS k, sum(n) AS n FROM m GROUP BY 1) t JOIN (SELECT pred AS k, sum(n) AS n FROM m GROUP BY 1) p ON p.k = t.k)
SELECT truth, pred, m.n, round(m.n / CAST(sum(m.n) OVER (PARTITION BY truth) AS DOUBLE), 6) AS share,
  round((CAST(hit AS DOUBLE) / s.n - CAST(e AS DOUBLE) / s.n / s.n) / (1 - CAST(e AS DOUBLE) / s.n / s.n), 6) AS kappa FROM m CROSS JOIN s CROSS JOIN e""")
def confusion_matrix(t: Tables) -> DataFrame:
    m = confusion(t)
    every = Window.partitionBy()  # a row for each pair of classes
    rows = m.withColumns({"by_truth": F.sum("n").over(Window.partitionBy("truth")), "by_pred": F.sum("n").over(Window.partitionBy("pred")), "all": F.sum("n").over(every), "hit": F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).over(every)})
    chance = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("by_truth") * F.col("by_pred")).otherwise(0)).over(every) / F.col("all") / F.col("all")
    return rows.withColumn("e", chance).select("truth", "pred", "n", F.round(F.col("n") / F.col("by_truth"), 6).alias("share"), F.round((F.col("hit") / F.col("all") - F.col("e")) / (1 - F.col("e")), 6).alias("kappa"))


@query(f"""WITH m AS ({_CONF}), k AS (SELECT truth AS cls FROM m UNION SELECT pred FROM m),
p AS (SELECT cls, CAST(sum(CASE WHEN truth = cls AND pred = cls THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN truth = cls THEN n ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN pred = cls THEN n ELSE 0 END) AS DOUBLE) AS pn, CAST(sum(n) AS DOUBLE) AS total FROM m CROSS JOIN k GROUP BY 1)
SELECT cls, round(tp / tn, 6) AS recall, round(tp / pn, 6) AS precision, round(2 * tp / (tn + pn), 6) AS f1, round(tp / (tn + pn - tp), 6) AS iou,
  round(avg(tp / (tn + pn - tp)) OVER (), 6) AS mean_iou, round(sum(tp) OVER () / total, 6) AS accuracy FROM p""")
def confusion_scores(t: Tables) -> DataFrame:
    m = confusion(t)
    side = lambda c: m.groupBy(F.col(c).alias("cls")).agg(F.sum("n").cast("double").alias(c))
    hits = m.where("truth = pred").groupBy(F.col("truth").alias("cls")).agg(F.sum("n").cast("double").alias("tp"))
    p = side("truth").join(side("pred"), "cls", "full").join(hits, "cls", "left").fillna(0.0)
    every = Window.partitionBy()
    iou = F.col("tp") / (F.col("truth") + F.col("pred") - F.col("tp"))
    return p.select("cls", F.round(F.try_divide("tp", "truth"), 6).alias("recall"), F.round(F.try_divide("tp", "pred"), 6).alias("precision"), F.round(2 * F.col("tp") / (F.col("truth") + F.col("pred")), 6).alias("f1"), F.round(iou, 6).alias("iou"), F.round(F.avg(iou).over(every), 6).alias("mean_iou"), F.round(F.sum("tp").over(every) / F.sum("truth").over(every), 6).alias("accuracy"))


_PAIR = "SELECT scene_id AS img, b1 % 3 AS truth, b2 % 3 AS pred FROM px"


def _overlaps(t: Tables) -> DataFrame:
    """img, cls, inter, total: cells of both, of either."""
    pairs = t.px.select(F.col("scene_id").alias("img"), (F.col("b1") % 3).alias("truth"), (F.col("b2") % 3).alias("pred"))
    rows = pairs.select("img", "truth", "pred", F.explode(F.array_distinct(F.array("truth", "pred"))).alias("cls"))
    return rows.groupBy("img", "cls").agg(F.count_if(F.col("truth") == F.col("pred")).alias("inter"), F.count("*").alias("total"))


_OVER = f"p AS ({_PAIR}), k AS (SELECT DISTINCT truth AS cls FROM p UNION SELECT DISTINCT pred FROM p), o AS (SELECT img, cls, count(*) FILTER (WHERE truth = cls AND pred = cls) AS inter, count(*) FILTER (WHERE truth = cls OR pred = cls) AS total FROM p CROSS JOIN k GROUP BY 1, 2)"


@query(f"WITH {_OVER} SELECT img, round(avg(CASE WHEN total = 0 THEN 0.0 ELSE inter / CAST(total AS DOUBLE) END), 6) AS mean_iou FROM o GROUP BY 1")
def mean_iou_per_image(t: Tables) -> DataFrame:
    return _overlaps(t).groupBy("img").agg(F.round(F.sum(F.col("inter") / F.col("total")) / 3, 6).alias("mean_iou"))


@query(f"WITH {_OVER}, s AS (SELECT cls, CAST(sum(inter) AS DOUBLE) / sum(total) AS iou FROM o GROUP BY 1) SELECT round(avg(iou), 6) AS mean_iou FROM s")
def mean_iou_dataset(t: Tables) -> DataFrame:
    return _overlaps(t).groupBy("cls").agg((F.sum("inter") / F.sum("total")).alias("iou")).agg(F.round(F.avg("iou"), 6).alias("mean_iou"))


@query(f"""WITH p AS ({_PAIR}), s AS (SELECT img, CAST(sum(CASE WHEN truth = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS i, sum(CASE WHEN truth = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS b FROM p GROUP BY 1)
SELECT img, round((i + 1e-15) / (a + b - i + 1e-15), 6) AS iou, round((2 * i + 1e-15) / (a + b + 1e-15), 6) AS dice FROM s""")
def iou_dice(t: Tables) -> DataFrame:
    truth, pred = (F.col("b1") % 3 == 1), (F.col("b2") % 3 == 1)
    s = t.px.groupBy(F.col("scene_id").alias("img")).agg(F.count_if(truth & pred).alias("i"), F.count_if(truth).alias("a"), F.count_if(pred).alias("b"))
    return s.select("img", F.round((F.col("i") + 1e-15) / (F.col("a") + F.col("b") - F.col("i") + 1e-15), 6).alias("iou"), F.round((2 * F.col("i") + 1e-15) / (F.col("a") + F.col("b") + 1e-15), 6).alias("dice"))


@query("""WITH a AS (SELECT DISTINCT img, x, y FROM (SELECT img, unnest(range(xmin // 4, xmax // 4 + 1)) AS x, ymin, ymax FROM boxes) b, unnest(range(ymin // 4, ymax // 4 + 1)) AS u(y)),
b AS (SELECT DISTINCT img, x, y FROM (SELECT img, unnest(range(xmin // 4, xmax // 4 + 1)) AS x, ymin, ymax FROM truths) b, unnest(range(ymin // 4, ymax // 4 + 1)) AS u(y))
SELECT round(count(CASE WHEN a.img IS NOT NULL AND b.img IS NOT NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS iou FROM a FULL JOIN b ON a.img = b.img AND a.x = b.x AND a.y = b.y""")
def polygon_set_iou(t: Tables) -> DataFrame:
    cover = lambda d, name: spatial.in_cells(d, 4).select("img", "gx", "gy").distinct().withColumn(name, F.lit(True))
    both = cover(t.boxes, "a").join(cover(t.truths, "b"), ["img", "gx", "gy"], "full")
    return both.agg(F.round(F.count_if(F.col("a") & F.col("b")) / F.count("*"), 6).alias("iou"))


@query("""SELECT round(count(*) FILTER (WHERE b.cls = 1 AND a.cls <> 1) * 0.0001, 6) AS green_to_none, round(count(*) FILTER (WHERE b.cls <> 1 AND a.cls = 1) * 0.0001, 6) AS none_to_green
FROM cls_before b JOIN cls_after a ON a.r = b.r AND a.c = b.c""")
def change_area(t: Tables) -> DataFrame:
    both = t.cls_before.withColumnRenamed("cls", "b").join(t.cls_after.withColumnRenamed("cls", "a"), ["r", "c"])
    return both.agg(F.round(F.count_if((F.col("b") == 1) & (F.col("a") != 1)) * 0.0001, 6).alias("green_to_none"), F.round(F.count_if((F.col("b") != 1) & (F.col("a") == 1)) * 0.0001, 6).alias("none_to_green"))


@query("SELECT scene_id, round(count(*) FILTER (WHERE b1 / 50.0 >= 0.4) * 0.0001, 6) AS forest_km2, round(count(*) FILTER (WHERE b2 >= 5 AND b1 / 50.0 < 0.4) * 0.0001, 6) AS other_green_km2 FROM px GROUP BY 1")
def forest_area(t: Tables) -> DataFrame:
    forest, green = F.col("b1") / 50.0 >= 0.4, F.col("b2") >= 5
    return t.px.groupBy("scene_id").agg(F.round(F.count_if(forest) * 0.0001, 6).alias("forest_km2"), F.round(F.count_if(green & ~forest) * 0.0001, 6).alias("other_green_km2"))


@query("""SELECT id, round(6378137.0 * radians(0.01) / 100, 6) AS width_m,
  round((6378137.0 * ln(tan(pi() / 4 + radians(y / 20.0 + 0.01) / 2)) - 6378137.0 * ln(tan(pi() / 4 + radians(y / 20.0) / 2))) / 100, 6) AS height_m FROM points""")
def pixel_size_m(t: Tables) -> DataFrame:
    from ..functions.geometry import to_mercator

    x0, y0 = to_mercator(F.col("x") / 20.0, F.col("y") / 20.0)
    x1, y1 = to_mercator(F.col("x") / 20.0 + 0.01, F.col("y") / 20.0 + 0.01)
    return t.points.select("id", F.round((x1 - x0) / 100, 6).alias("width_m"), F.round((y1 - y0) / 100, 6).alias("height_m"))


@query("SELECT scene_id, count(*) FILTER (WHERE b1 = 50) AS cloud FROM px GROUP BY 1")
def cloud_pixel_count(t: Tables) -> DataFrame:
    return t.px.groupBy("scene_id").agg(F.count_if(F.col("b1") == 50).alias("cloud"))


@query("SELECT n_name AS category, count(s_suppkey) AS objects, count(DISTINCT s_suppkey % 10) AS images FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    return t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("category")).agg(F.count("s_suppkey").alias("objects"), F.count_distinct(F.col("s_suppkey") % 10).alias("images"))


@query("SELECT img, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxes GROUP BY 1")
def layer_bbox(t: Tables) -> DataFrame:
    return t.boxes.groupBy("img").agg(*[(F.min if "min" in s else F.max)(s).alias(s) for s in spatial.SIDES])


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS term FROM documents),
f AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 2)
SELECT term, tf, df FROM f ORDER BY tf DESC, term LIMIT 1000""")
def vocab_build(t: Tables) -> DataFrame:
    return _terms(t).where("df > 2").orderBy(F.desc("tf"), "term").limit(1000)


def _terms(t: Tables) -> DataFrame:
    """term, tf, df of the documents' words; a row is a document."""
    # A row's words in order: the first of equal ones counts the document, so that one shuffle, by term, is left, before
    # which a frequent term is combined.
    ordered = once(t.documents.select("text"), w=F.array_sort(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: w != ""))).where("size(w) > 0")
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1))
    words = ordered.select(F.explode(F.zip_with("w", before, lambda a, b: F.struct(a.alias("term"), (a != b).cast("long").alias("first")))).alias("e")).select("e.*")
    return words.groupBy("term").agg(F.count("*").alias("tf"), F.sum("first").alias("df"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS term FROM documents),
f AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT term, tf, df FROM f ORDER BY tf DESC, term LIMIT 100000""")
def vocab_build_full(t: Tables) -> DataFrame:
    """The vocabulary of the reference's own size: 100 * 1000 terms of more than one document."""
    order = [F.desc("tf"), F.col("term").asc()]
    return running(_terms(t).where("df > 1"), order).where("_rank < 100000").select("term", "tf", "df").orderBy(*order)


_CLICKS = "SELECT 'type' AS col, p_type AS val FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'segment', c_mktsegment FROM customer"


@query(f"WITH v AS ({_CLICKS}), n AS (SELECT col, val, count(*) AS n FROM v GROUP BY 1, 2) SELECT col, val, n, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, val) - 1 AS INT) AS id FROM n")
def click_vocab(t: Tables) -> DataFrame:
    long = t.part.select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).unpivot([], ["type", "brand"], "col", "val").union(t.customer.select(F.lit("segment"), "c_mktsegment"))
    n = long.groupBy("col", "val").agg(F.count("*").alias("n"))
    return running(n, [F.desc("n"), F.col("val").asc()], by=["col"]).select("col", "val", "n", F.col("_rank").cast("int").alias("id"))


@query("SELECT user_id, item_id, rating, ts FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ratings) WHERE n >= 20")
def min_support_filter(t: Tables) -> DataFrame:
    # The counts come back by a semi join, so that a user with very many ratings isn't one task's work.
    often = t.ratings.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 20")
    return t.ratings.join(often, "user_id", "left_semi")


@query("""WITH s AS (SELECT user_id, coalesce(value, 0.0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, count(*) AS n, round(regr_slope(v, i), 6) + 0.0 AS slope FROM s GROUP BY 1 HAVING count(*) > 1""")
def pixel_trend_slope(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = t.events.select("user_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"), i.alias("i"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.regr_slope("v", "i"), 6).alias("slope")).where("n > 1")
