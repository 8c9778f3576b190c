"""Files written and read again: tiles, layers, annotations, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.orders import running
from ..operators.spatial import dealt
from ..scratch import scratch
from ..sources import files
from .aggregates import zonal_class_area
from .base import Tables, query


@query("SELECT scene_id, r // 50 AS tile_row, c // 50 AS tile_col, count(*) AS cells, CAST(sum(b1) AS BIGINT) AS total FROM px GROUP BY 1, 2, 3")
def scan_tiles(t: Tables) -> DataFrame:
    path = scratch(t.spark, "tiles")
    tiles = t.px.groupBy("scene_id", F.floor(F.col("r") / 50).cast("int").alias("tile_row"), F.floor(F.col("c") / 50).cast("int").alias("tile_col")).agg(F.collect_list("b1").alias("cells"))
    tiles.write.partitionBy("scene_id").parquet(path)
    found = t.spark.read.parquet(path)
    return found.select("scene_id", "tile_row", "tile_col", F.size("cells").cast("long").alias("cells"), F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT c_custkey AS id, c_name AS name, 'Point' AS geom_type, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1000 AS DOUBLE) AS y FROM customer")
def scan_geojson(t: Tables) -> DataFrame:
    path = scratch(t.spark, "geojson")
    named = t.points.join(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    files.write_geojson_points(dealt(named, "id"), path)
    return files.read_geojson(t.spark, path)


@query("SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points")
def scan_kml(t: Tables) -> DataFrame:
    path = scratch(t.spark, "kml")
    files.write_xml(t.points.select("id", F.format_string("<Placemark><name>%d</name><Point><coordinates>%d,%d</coordinates></Point></Placemark>", "id", "x", "y").alias("xml")), "kml", path)
    return files.read_placemarks(t.spark, path, "Placemark", "coordinates")


@query("SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points")
def scan_gml(t: Tables) -> DataFrame:
    path = scratch(t.spark, "gml")
    files.write_xml(t.points.select("id", F.format_string("<featureMember><name>%d</name><Point><pos>%d %d</pos></Point></featureMember>", "id", "x", "y").alias("xml")), "FeatureCollection", path)
    return files.read_placemarks(t.spark, path, "featureMember", "pos")


@query("SELECT id, xmin, ymin, xmax, ymax FROM boxes WHERE xmax > xmin AND ymax > ymin")
def layer_load_validated(t: Tables) -> DataFrame:
    layer = t.boxes.withColumn("geom_type", F.when(F.col("id") % 2 == 0, "Polygon").otherwise("MultiPolygon"))
    sides = ["xmin", "ymin", "xmax", "ymax"]
    return files.validated(layer, (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")), "geom_type", sides).select("id", *sides)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def scan_table_filtered(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT id, CAST(1 AS INT) AS parts, xmin AS first_x, CAST(NULL AS VARCHAR) AS note FROM boxes")
def sink_table_reconcile(t: Tables) -> DataFrame:
    path = scratch(t.spark, "target")
    layer = t.boxes.select("id", F.array("xmin", "ymin").alias("geometry"), "score")
    files.reconciled(layer, ["id", "geometry", "note"]).withColumn("note", F.col("note").cast("string")).write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path).select("id", F.size("geometry").alias("parts"), F.col("geometry")[0][0].alias("first_x"), "note")


@query("SELECT id, score FROM boxes WHERE score > 1200")
def sink_layer_filtered(t: Tables) -> DataFrame:
    path = scratch(t.spark, "layer")
    stamped = t.boxes.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    stamped.where("score > 1200").drop("created_at", "updated_at").write.json(path)
    return t.spark.read.schema("id long, score double").json(path)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS zone, count(*) AS n FROM orders GROUP BY 1, 2")
def scan_csv_with_year(t: Tables) -> DataFrame:
    path = scratch(t.spark, "years")
    n = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("zone")).agg(F.count("*").alias("n"))
    n.select("zone", "n", F.concat(F.lit("stat_"), F.col("year").cast("string")).alias("name")).write.partitionBy("name").option("header", "true").csv(path)
    read = t.spark.read.schema("zone string, n long").option("header", "true").option("recursiveFileLookup", "true").csv(path)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), r"stat_(\d{4})", 1).cast("int").alias("year"), "zone", "n")


@query("SELECT zone, cls, count(*) * 100 AS area_m2, 'm2' AS unit FROM cls_before JOIN zones z ON c >= z.xmin AND c < z.xmax AND r >= z.ymin AND r < z.ymax GROUP BY 1, 2")
def sink_stats_csv(t: Tables) -> DataFrame:
    path = scratch(t.spark, "stats")
    zonal_class_area(t).withColumn("unit", F.lit("m2")).write.option("header", "true").csv(path)
    return t.spark.read.schema("zone string, cls int, area_m2 long, unit string").option("header", "true").csv(path)


@query("SELECT user_id, item_id, rating FROM ratings")
def regularize_delimited(t: Tables) -> DataFrame:
    raw, clean = scratch(t.spark, "raw"), scratch(t.spark, "clean")
    t.ratings.select(F.concat_ws("::", "user_id", "item_id", "rating")).write.text(raw)
    t.spark.read.option("sep", "::").schema("user_id long, item_id long, rating int").csv(raw).write.option("header", "true").option("quoteAll", "true").csv(clean)
    return t.spark.read.option("header", "true").schema("user_id long, item_id long, rating int").csv(clean)


_PIX = "CAST(floor(xmin * 1.5) AS INT) AS xmin, CAST(floor(ymin * 1.5) AS INT) AS ymin, CAST(floor(xmax * 1.5) AS INT) AS xmax, CAST(floor(ymax * 1.5) AS INT) AS ymax"


@query(f"SELECT 'img_' || img || '.tif' AS filename, 512 AS width, 512 AS height, 'object' AS class, {_PIX} FROM boxes WHERE (xmax - xmin) * (ymax - ymin) > 20")
def sink_voc_rows(t: Tables) -> DataFrame:
    path = scratch(t.spark, "voc")
    px = [F.floor(F.col(c) * 1.5).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    rows = t.boxes.where("(xmax - xmin) * (ymax - ymin) > 20").select(F.format_string("img_%d.tif", "img").alias("filename"), F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit("object").alias("class"), *px)
    rows.write.option("header", "true").csv(path)
    return t.spark.read.option("header", "true").schema(rows.schema).csv(path)


@query("""SELECT img, printf('0 %.6f %.6f %.6f %.6f', round(CAST((xmin + xmax) / 1024.0 AS DOUBLE), 6), round(CAST((ymin + ymax) / 1024.0 AS DOUBLE), 6), round(CAST((xmax - xmin) / 512.0 AS DOUBLE), 6), round(CAST((ymax - ymin) / 512.0 AS DOUBLE), 6)) AS line FROM boxes""")
def sink_yolo_rows(t: Tables) -> DataFrame:
    path = scratch(t.spark, "yolo")
    line = F.format_string("0 %.6f %.6f %.6f %.6f", (F.col("xmin") + F.col("xmax")) / 1024.0, (F.col("ymin") + F.col("ymax")) / 1024.0, (F.col("xmax") - F.col("xmin")) / 512.0, (F.col("ymax") - F.col("ymin")) / 512.0)
    t.boxes.select("img", line.alias("line")).write.partitionBy("img").text(path)
    return t.spark.read.text(path).select(F.col("img").cast("long").alias("img"), F.col("value").alias("line"))


@query("""SELECT img AS image_id, CAST(row_number() OVER (PARTITION BY img ORDER BY id) AS INT) AS annotation, (xmax - xmin) * (ymax - ymin) AS area, '[' || ymin || ',' || xmin || ',' || (ymax - ymin) || ',' || (xmax - xmin) || ']' AS bbox,
  '[[' || xmin || ',' || ymin || ',' || xmax || ',' || ymin || ',' || xmax || ',' || ymax || ',' || xmin || ',' || ymax || ']]' AS segmentation FROM boxes""")
def sink_coco(t: Tables) -> DataFrame:
    path = scratch(t.spark, "coco")
    n = F.row_number().over(Window.partitionBy("img").orderBy("id"))
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    corners = F.array(F.array("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax"))
    rows = t.boxes.select(F.to_json(F.struct(F.col("img").alias("image_id"), n.alias("annotation"), (w * h).alias("area"), F.array(F.col("ymin"), F.col("xmin"), h, w).alias("bbox"), corners.alias("segmentation"))).alias("value"))
    rows.write.text(path)
    back = t.spark.read.schema("image_id long, annotation int, area int, bbox array<int>, segmentation array<array<int>>").json(path)
    return back.select("image_id", "annotation", "area", F.to_json("bbox").alias("bbox"), F.to_json("segmentation").alias("segmentation"))


@query("""WITH m AS (SELECT id, unnest([xmin + 1, xmax + 400]) AS s, unnest([ymin % 7 + 1, 3]) AS l FROM boxes), c AS (SELECT id, unnest(range(s - 1, s + l - 1)) AS i FROM m) SELECT id, CAST(i % 300 AS INT) AS r, CAST(i // 300 AS INT) AS c FROM c""")
def coco_from_rle(t: Tables) -> DataFrame:
    runs = F.format_string("%d %d %d 3", F.col("xmin") + 1, F.col("ymin") % 7 + 1, F.col("xmax") + 400)
    return files.decode_runs(t.boxes.select("id", runs.alias("runs")), "id", "runs", 300)


@query("""WITH a AS (SELECT 'a' AS src, id, img FROM boxes UNION ALL SELECT 'b', id, img FROM truths) SELECT src, id, CAST(dense_rank() OVER (ORDER BY src, img) AS BIGINT) AS image_id FROM a""")
def coco_merge(t: Tables) -> DataFrame:
    a = t.boxes.select(F.lit("a").alias("src"), "id", "img").union(t.truths.select(F.lit("b"), "id", "img"))
    images = running(a.select("src", "img").distinct(), [F.col("src"), F.col("img")]).select("src", "img", (F.col("_rank") + 1).cast("long").alias("image_id"))
    return a.join(images, ["src", "img"]).select("src", "id", "image_id")


@query("""SELECT n_nationkey AS image_id, n_name AS name, count(s_suppkey) AS boxes, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def annotations_to_examples(t: Tables) -> DataFrame:
    j = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    e = j.groupBy(F.col("n_nationkey").alias("image_id"), F.col("n_name").alias("name")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("a"))
    return e.select("image_id", "name", F.size("a").cast("long").alias("boxes"), F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("ids"))


_SEVEN = "img, xmin, ymin, xmax, ymax"


@query(f"SELECT coalesce(b.id, -1) AS box, coalesce(t.id, -1) AS mask, coalesce(b.img, t.img) AS img FROM boxes b FULL JOIN (SELECT id, img, xmin, ymin, xmin + 12 AS xmax, ymin + 9 AS ymax FROM truths) t ON b.img = t.img AND b.xmin = t.xmin AND b.ymin = t.ymin AND b.xmax = t.xmax AND b.ymax = t.ymax")
def scan_oid_boxes(t: Tables) -> DataFrame:
    masks = t.truths.select(F.col("id").alias("mask"), "img", "xmin", "ymin", (F.col("xmin") + 12).alias("xmax"), (F.col("ymin") + 9).alias("ymax"))
    both = t.boxes.withColumnRenamed("id", "box").join(masks, _SEVEN.split(", "), "full_outer")
    return both.select(F.coalesce("box", F.lit(-1)).alias("box"), F.coalesce("mask", F.lit(-1)).alias("mask"), "img")


@query("WITH m AS (SELECT page_id, sha256(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages) SELECT page_id, h AS tile_id, min(page_id) OVER (PARTITION BY h) AS first_page, CAST(n AS BIGINT) AS bytes FROM m")
def tile_store_pack(t: Tables) -> DataFrame:
    images, index = scratch(t.spark, "images"), scratch(t.spark, "map")
    blobs = t.pages.select("page_id", F.coalesce("html", F.lit("")).alias("data")).withColumn("tile_id", F.sha2("data", 256))
    blobs.select("page_id", "tile_id").write.parquet(index)
    blobs.groupBy("tile_id").agg(F.min("page_id").alias("first_page"), F.first("data").alias("data")).write.parquet(images)
    view = t.spark.read.parquet(index).join(t.spark.read.parquet(images), "tile_id")
    return view.select("page_id", "tile_id", "first_page", F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def merge_datasets(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id")), t.supplier.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"))]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT img, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, max(score) AS best FROM boxes GROUP BY 1")
def rows_by_image(t: Tables) -> DataFrame:
    g = t.boxes.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("rows"))
    return g.select("img", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("ids"), F.array_max(F.transform("rows", lambda r: r["score"])).alias("best"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, 5 AS shards FROM orders")
def reshard(t: Tables) -> DataFrame:
    path = scratch(t.spark, "shards")
    t.orders.select("o_orderkey").repartition(5).write.parquet(path)
    back = t.spark.read.parquet(path)
    return back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"), F.count_distinct(F.col("_metadata.file_name")).cast("int").alias("shards"))


@query("SELECT count(*) AS n, 4326 AS srid, 'Polygon' AS geom_type, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxes")
def layer_metadata(t: Tables) -> DataFrame:
    layer = t.boxes.withColumns({"srid": F.lit(4326), "geom_type": F.lit("Polygon")})
    return layer.agg(F.count("*").alias("n"), F.first("srid").alias("srid"), F.first("geom_type").alias("geom_type"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
