"""Mosaics, overlays, orders, splits, top-k, set operations and focal filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detections, grids, orders, raster, sampling
from .base import Tables, query


@query("SELECT r, c, arg_min(b1, CASE scene_id WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS b1 FROM px WHERE b1 > 10 GROUP BY 1, 2")
def mosaic_first(t: Tables) -> DataFrame:
    order = F.when(F.col("scene_id") == "N", 0).when(F.col("scene_id") == "A", 1).otherwise(2)
    return raster.first_valid(t.px.where("b1 > 10"), order, "b1")


@query("SELECT r, c, arg_max(cls, layer) AS cls FROM (SELECT r, c, cls, 1 AS layer FROM cls_before UNION ALL SELECT r, c, CASE WHEN cls = 2 THEN 0 ELSE cls + 10 END, 2 FROM cls_after) WHERE cls <> 0 GROUP BY 1, 2")
def class_union(t: Tables) -> DataFrame:
    layers = t.cls_before.withColumn("layer", F.lit(1)).union(t.cls_after.select("r", "c", F.when(F.col("cls") == 2, 0).otherwise(F.col("cls") + 10).alias("cls"), F.lit(2).alias("layer")))
    return raster.last_layer(layers, F.col("layer"))


@query("SELECT b.r, b.c, CASE WHEN b.cls = 1 THEN 1 WHEN a.cls = 2 THEN 2 WHEN b.cls = 2 AND a.cls IS NULL THEN 0 ELSE 3 END AS cls FROM cls_before b LEFT JOIN cls_after a ON a.r = b.r AND a.c = b.c")
def class_union_rules(t: Tables) -> DataFrame:
    both = t.cls_before.withColumnRenamed("cls", "green").join(t.cls_after.withColumnRenamed("cls", "water"), ["r", "c"], "left")
    return both.select("r", "c", F.when(F.col("green") == 1, 1).when(F.col("water") == 2, 2).when((F.col("green") == 2) & F.col("water").isNull(), 0).otherwise(3).alias("cls"))


@query("SELECT r, c, CAST(max(CASE WHEN b1 > 45 OR b2 < 2 THEN 1 ELSE 0 END) AS INT) AS present FROM px GROUP BY 1, 2")
def mask_or(t: Tables) -> DataFrame:
    return t.px.groupBy("r", "c").agg(F.bool_or((F.col("b1") > 45) | (F.col("b2") < 2)).cast("int").alias("present"))


@query("SELECT scene % 50 AS field, scene, lead(scene) OVER (PARTITION BY scene % 50 ORDER BY acquired, scene) AS next_scene FROM scenes")
def consecutive_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("field").orderBy("acquired", "scene")
    return t.scenes.select((F.col("scene") % 50).alias("field"), "scene", "acquired").select("field", "scene", F.lead("scene").over(w).alias("next_scene"))


@query("SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS INT) AS n FROM lineitem")
def join_row_number(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber")).alias("n"))


@query("SELECT user_id, item_id, rating, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, rating DESC) = 1 THEN 'eval' ELSE 'train' END AS part FROM ratings")
def leave_last_out(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"), F.desc("rating"))
    return t.ratings.select("user_id", "item_id", "rating", F.when(F.row_number().over(w) == 1, "eval").otherwise("train").alias("part"))


@query("SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT user_id FROM ratings)")
def dense_ids(t: Tables) -> DataFrame:
    return sampling.dense_ids(t.ratings.select("user_id"), "user_id")


@query("SELECT user_id, item_id, ts, rating, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating) > 1 AS repeated FROM ratings")
def mask_duplicates(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "item_id").orderBy("ts", "rating")
    return t.ratings.select("user_id", "item_id", "ts", "rating", (F.row_number().over(w) > 1).alias("repeated"))


@query()
def nms(t: Tables) -> DataFrame:
    return detections.suppress(t.boxes, ["img"], 0.2)


@query()
def score_ranked_cover(t: Tables) -> DataFrame:
    return detections.suppress(t.boxes, ["img"], 0.0)


def _focal_sql(outer: str, inner: str | None = None) -> str:
    near = "(SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc)"
    step = lambda f, src: f"SELECT m.r, m.c, {f}(n.cls) AS cls FROM {src} m JOIN (SELECT r + dr AS r, c + dc AS c, cls FROM {src} CROSS JOIN {near}) n ON n.r = m.r AND n.c = m.c GROUP BY 1, 2"
    return f"WITH one AS ({step(inner, 'cls_before')}) {step(outer, 'one')}" if inner else step(outer, "cls_before")


@query(_focal_sql("max"))
def focal_dilate(t: Tables) -> DataFrame:
    return raster.dilate(t.cls_before, raster.kernel(3))


@query(_focal_sql("min"))
def focal_erode(t: Tables) -> DataFrame:
    return raster.erode(t.cls_before, raster.kernel(3))


@query(_focal_sql("max", "min"))
def focal_open(t: Tables) -> DataFrame:
    return raster.opening(t.cls_before, raster.kernel(3))


@query(_focal_sql("min", "max"))
def focal_close(t: Tables) -> DataFrame:
    return raster.closing(t.cls_before, raster.kernel(3))


@query(f"WITH d AS ({_focal_sql('max')}), e AS ({_focal_sql('min')}) SELECT d.r, d.c, d.cls - e.cls AS cls FROM d JOIN e ON e.r = d.r AND e.c = d.c")
def focal_gradient(t: Tables) -> DataFrame:
    return raster.gradient(t.cls_before, raster.kernel(3))


def _large_sql(f: str, half: int, table: str = "cls_before") -> str:
    return f"SELECT a.r, a.c, {f}(b.cls) AS cls FROM {table} a JOIN {table} b ON b.r BETWEEN a.r - {half} AND a.r + {half} AND b.c BETWEEN a.c - {half} AND a.c + {half} GROUP BY 1, 2"


@query(_large_sql("max", 5))
def focal_dilate_large(t: Tables) -> DataFrame:
    """A square of 11 x 11."""
    return grids.focal(t.cls_before, "dilate", 11)


@query(_large_sql("min", 4))
def focal_erode_large(t: Tables) -> DataFrame:
    """A square of 9 x 9."""
    return grids.focal(t.cls_before, "erode", 9)


@query(f"WITH o AS ({_large_sql('min', 3)}) {_large_sql('max', 3, 'o')}")
def focal_open_large(t: Tables) -> DataFrame:
    """A square of 7 x 7."""
    return grids.focal(t.cls_before, "open", 7)


@query("""WITH w AS (SELECT r, c, cls, unnest(range(greatest(0, (r - 16 + 8) // 8), r // 8 + 1)) * 8 AS top FROM cls_before), v AS (SELECT w.*, x.l * 8 AS "left" FROM w, unnest(range(greatest(0, (c - 16 + 8) // 8), c // 8 + 1)) AS x(l))
SELECT top, "left", count(*) AS cells, CAST(sum(cls) AS BIGINT) AS total FROM v GROUP BY 1, 2""")
def tile_windows(t: Tables) -> DataFrame:
    return raster.tile_windows(t.cls_before, 16, 8).groupBy("top", "left").agg(F.count("*").alias("cells"), F.sum("cls").alias("total")).select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "cells", "total")


@query("SELECT a.r, a.c, median(CAST(b.cls AS DOUBLE)) AS median FROM cls_before a JOIN cls_before b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2")
def halo_windows(t: Tables) -> DataFrame:
    return detections.by_halo(t.cls_before, 25, 2, detections.median_around(2), out="median")


@query("SELECT r, c, CASE WHEN r % 20 < 15 AND c % 20 < 15 THEN 0 ELSE cls END AS cls FROM cls_before")
def lattice_clear(t: Tables) -> DataFrame:
    return t.cls_before.select("r", "c", F.when((F.col("r") % 20 < 15) & (F.col("c") % 20 < 15), 0).otherwise(F.col("cls")).alias("cls"))


# -- sorts, limits, top-k, sampling


@query("WITH n AS (SELECT scene_id, count(*) FILTER (WHERE b1 = 50) AS cloud FROM px GROUP BY 1) SELECT scene_id, cloud, CAST(row_number() OVER (ORDER BY CASE WHEN scene_id = 'N' THEN 0 ELSE 1 END, cloud, scene_id) AS INT) AS place FROM n")
def scenes_by_cloud(t: Tables) -> DataFrame:
    n = t.px.groupBy("scene_id").agg(F.count_if(F.col("b1") == 50).alias("cloud"))
    order = [F.when(F.col("scene_id") == "N", 0).otherwise(1), F.col("cloud"), F.col("scene_id")]
    return orders.running(n, order).select("scene_id", "cloud", (F.col("_rank") + 1).cast("int").alias("place")).orderBy("place")


@query("SELECT scene, CAST(scene * 7 % 90 AS INT) AS haze FROM scenes ORDER BY scene * 7 % 90, scene LIMIT 500")
def scenes_by_haze(t: Tables) -> DataFrame:
    name = F.concat_ws("_", F.lit("S2"), F.col("scene").cast("string"), (F.col("scene") * 7 % 90).cast("string"), F.lit("x"))
    return t.scenes.select("scene", F.element_at(F.split(name, "_"), -2).cast("int").alias("haze")).orderBy("haze", "scene").limit(500)


@query("SELECT DISTINCT 'T' || month(acquired) || '-' || year(acquired) AS name, CAST(year(acquired) AS INT) AS y, CAST(month(acquired) AS INT) AS m FROM scenes")
def months_sorted(t: Tables) -> DataFrame:
    name = F.concat(F.lit("T"), F.month("acquired").cast("string"), F.lit("-"), F.year("acquired").cast("string"))
    part = lambda i: F.regexp_extract("name", r"T(\d+)-(\d+)", i).cast("int")
    return t.scenes.select(name.alias("name")).distinct().select("name", part(2).alias("y"), part(1).alias("m")).orderBy("y", "m")


@query("SELECT scene % 50 AS field, arg_min(scene, (cloud, scene)) AS scene, min(cloud) AS cloud FROM scenes GROUP BY 1")
def least_cloudy(t: Tables) -> DataFrame:
    return t.scenes.groupBy((F.col("scene") % 50).alias("field")).agg(F.min_by("scene", F.struct("cloud", "scene")).alias("scene"), F.min("cloud").alias("cloud"))


@query("SELECT scene, acquired, cloud FROM scenes ORDER BY acquired DESC, scene LIMIT 1000")
def catalog_latest(t: Tables) -> DataFrame:
    return t.scenes.orderBy(F.desc("acquired"), "scene").limit(1000)


@query("SELECT cls % 20 AS cls, q, n, score FROM (SELECT *, row_number() OVER (PARTITION BY cls % 20 ORDER BY score DESC, q, n) AS k FROM preds) WHERE k <= 20")
def topk_per_group(t: Tables) -> DataFrame:
    p = t.preds.select((F.col("cls") % 20).alias("cls"), "q", "n", "score")
    return p.withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "q", "n"))).where("k <= 20").drop("k")


@query("""WITH s AS (SELECT scene, row_number() OVER (ORDER BY md5(CAST(scene AS VARCHAR) || ':0'), scene) - 1 AS k, count(*) OVER () AS n FROM scenes)
SELECT scene, CASE WHEN k < floor(CAST(0.7 AS DOUBLE) * n + 0.5) THEN 'train' WHEN k < floor(CAST(0.9 AS DOUBLE) * n + 0.5) THEN 'val' ELSE 'test' END AS part FROM s""")
def split_train_val_test(t: Tables) -> DataFrame:
    return sampling.split(t.scenes.select("scene"), "scene", {"train": 0.7, "val": 0.2, "test": 0.1})


@query("""WITH s AS (SELECT scene, cloud < 60 AS empty FROM scenes), n AS (SELECT least(count(*) FILTER (WHERE empty), floor(CAST(0.3 AS DOUBLE) * count(*) FILTER (WHERE NOT empty) / (1 - CAST(0.3 AS DOUBLE)))) AS keep FROM s),
e AS (SELECT scene, row_number() OVER (ORDER BY md5(CAST(scene AS VARCHAR) || ':0'), scene) AS k FROM s WHERE empty)
SELECT scene, false AS empty FROM s WHERE NOT empty UNION ALL SELECT scene, true FROM e CROSS JOIN n WHERE k <= keep""")
def downsample_empty(t: Tables) -> DataFrame:
    return sampling.downsample(t.scenes.select("scene", (F.col("cloud") < 60).alias("empty")), "scene", "empty", 0.3)


@query("SELECT cls % 5 AS label, count(*) AS n, round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight FROM preds GROUP BY 1")
def balanced_weights(t: Tables) -> DataFrame:
    n = t.preds.groupBy((F.col("cls") % 5).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each label
    return n.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


# -- set operations


@query("SELECT 'boxes' AS layer, id, score FROM boxes UNION ALL SELECT 'truths', id, NULL FROM truths")
def union_layers(t: Tables) -> DataFrame:
    return t.boxes.select(F.lit("boxes").alias("layer"), "id", "score").unionByName(t.truths.select(F.lit("truths").alias("layer"), "id"), allowMissingColumns=True)


@query("SELECT xmin, ymin, xmax, ymax FROM boxes UNION SELECT xmin, ymin, xmax, ymax FROM truths")
def distinct_shapes(t: Tables) -> DataFrame:
    sides = ("xmin", "ymin", "xmax", "ymax")
    return t.boxes.select(*sides).union(t.truths.select(*sides)).dropDuplicates()


@query("SELECT DISTINCT cloud, acquired FROM scenes")
def distinct_scenes(t: Tables) -> DataFrame:
    halves = [t.scenes.where(F.col("scene") % 3 != i).select("cloud", "acquired") for i in (0, 1)]
    return reduce(DataFrame.union, halves).distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def keys_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def keys_intersect(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("""WITH under AS (SELECT DISTINCT r, c FROM px WHERE b1 = 50)
SELECT r, c, cls, 'old' AS layer FROM cls_before a WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.r = a.r AND u.c = a.c)
UNION ALL SELECT b.r, b.c, b.cls, 'new' FROM cls_after b JOIN under u ON u.r = b.r AND u.c = b.c""")
def layer_patch(t: Tables) -> DataFrame:
    return raster.patched(t.cls_before, t.cls_after, t.px.where("b1 = 50"))


@query("""WITH f AS (SELECT c_nationkey AS field, c_mktsegment AS name, c_acctbal FROM customer), w AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'SHIP']) AS name)
SELECT n_nationkey AS field, coalesce(string_agg(w.name, ',' ORDER BY w.name) FILTER (WHERE h.name IS NULL), '') AS missing, count(*) FILTER (WHERE h.name IS NULL) = 0 AS subset
FROM nation CROSS JOIN w LEFT JOIN (SELECT DISTINCT field, name FROM f WHERE c_acctbal > 0) h ON h.field = n_nationkey AND h.name = w.name GROUP BY 1""")
def subset_check(t: Tables) -> DataFrame:
    values = t.nation.join(t.customer.where("c_acctbal > 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("field"), F.col("c_mktsegment").alias("name"))
    found = sampling.subset_of_values(values, "field", "name", ["AUTOMOBILE", "BUILDING", "SHIP"])
    return found.select("field", F.array_join("missing", ",").alias("missing"), "subset")
