"""Geometry, tile math, small conversions, texts, regions and learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..functions.indices import NDVI_LEGEND
from ..operators import detections, learned, orders, raster, rings, spatial, vectors
from ..scratch import written
from .base import Tables, query



def triangles(t: Tables) -> DataFrame:
    """id, ring: a triangle for each box, by its corners and the middle of its upper side; flat where the box is."""
    xs = [g.point(F.col("xmin"), F.col("ymin")), g.point(F.col("xmax"), F.col("ymin")), g.point((F.col("xmin") + F.col("xmax")) / 2, F.col("ymax")), g.point(F.col("xmin"), F.col("ymin"))]
    return t.boxes.select("id", "xmin", "ymin", "xmax", "ymax", F.array(*xs).alias("ring"))


@query("SELECT id, round((2.0 * xmin + xmax + xmax) / 4 * 0 + (xmin + xmax + (xmin + xmax) / 2.0) / 3, 6) AS x, round((2.0 * ymin + ymax) / 3, 6) AS y FROM boxes WHERE xmax > xmin AND ymax > ymin")
def geom_centroid(t: Tables) -> DataFrame:
    c = triangles(t).where("xmax > xmin and ymax > ymin").select("id", g.centroid(F.col("ring")).alias("p"))
    return c.select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""WITH s AS (SELECT id, xmin, ymin, xmax - xmin AS w, ymax - ymin AS h FROM boxes WHERE xmax > xmin AND ymax > ymin)
SELECT id, round(CASE WHEN id % 2 = 0 THEN xmin + w / 20.0 ELSE xmin + w / 2.0 END, 6) AS x, round(CASE WHEN id % 2 = 0 THEN ymin + h * (0.1 * 0.05 + 0.09 * 0.55) / CAST(0.19 AS DOUBLE) ELSE ymin + h / 3.0 END, 6) AS y FROM s""")
def geom_point_inside(t: Tables) -> DataFrame:
    """Triangles hold their centroids; narrow L shapes don't, and have a point in their upright part."""
    x, y, w, h = F.col("xmin"), F.col("ymin"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    corners = [(0, 0), (1, 0), (1, 0.1), (0.1, 0.1), (0.1, 1), (0, 1), (0, 0)]
    bent = F.array(*[g.point(x + w * a, y + h * b) for a, b in corners])
    shapes = triangles(t).where("xmax > xmin and ymax > ymin").select("id", F.when(F.col("id") % 2 == 0, bent).otherwise(F.col("ring")).alias("ring"))
    centred = rings.once(spatial.dealt(shapes, "id"), middle=g.centroid(F.col("ring")))
    found = rings.once(centred, p=g.point_inside(F.col("ring"), F.col("middle")))
    return found.select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""WITH s AS (SELECT id, x, y, unnest(range(0, 64)) AS i FROM points) SELECT id, CAST(i AS INT) AS i, round(x + 5 * cos(2 * pi() * i / 64), 6) + 0.0 AS px, round(y + 5 * sin(2 * pi() * i / 64), 6) + 0.0 AS py FROM s""")
def geom_buffer_point(t: Tables) -> DataFrame:
    ring = g.circle(F.col("x"), F.col("y"), F.lit(5.0))
    return spatial.dealt(t.points, "id").select("id", F.posexplode(F.slice(ring, 1, 64)).alias("i", "p")).select("id", "i", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("""WITH c AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS i, unnest([xmin, xmax, xmax, xmin, xmin]) AS x, unnest([ymin, ymin, ymax, ymax, ymin]) AS y FROM boxes),
s AS (SELECT id, i, floor(x / 16.0 + 0.5) * 16.0 AS x, floor(y / 16.0 + 0.5) * 16.0 AS y FROM c), k AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS px, lag(y) OVER (PARTITION BY id ORDER BY i) AS py FROM s)
SELECT id, CAST(count(*) AS INT) AS points FROM k WHERE px IS NULL OR px <> x OR py <> y GROUP BY 1""")
def geom_simplify(t: Tables) -> DataFrame:
    return t.boxes.select("id", F.size(g.simplify(g.box_ring(*(F.col(s) for s in spatial.SIDES)), 16.0)).alias("points"))


@query("""SELECT id, round(abs(radians((xmax - xmin) / 10.0) * (sin(radians(ymax / 10.0)) - sin(radians(ymin / 10.0)))) * 6371007.1809 * 6371007.1809 / 1e6, 3) AS km2 FROM boxes""")
def geom_area_geodesic(t: Tables) -> DataFrame:
    ring = g.box_ring(*(F.col(s) / 10.0 for s in spatial.SIDES))
    return t.boxes.select("id", F.round(g.geodesic_area(ring) / 1e6, 3).alias("km2"))


@query("SELECT id, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM boxes")
def geom_bbox(t: Tables) -> DataFrame:
    low_x, low_y, high_x, high_y = g.bounds(F.col("ring"))
    return triangles(t).select("id", low_x.alias("xmin"), low_y.alias("ymin"), high_x.alias("xmax"), high_y.alias("ymax"))


@query("SELECT scene_id, 105.5 + min(c) * 0.5 AS xmin, 21.25 - (max(r) + 1) * 0.5 AS ymin, 105.5 + (max(c) + 1) * 0.5 AS xmax, 21.25 - min(r) * 0.5 AS ymax FROM px GROUP BY 1")
def scene_footprint(t: Tables) -> DataFrame:
    e = t.px.groupBy("scene_id").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    return e.select("scene_id", (105.5 + F.col("c0") * 0.5).alias("xmin"), (21.25 - (F.col("r1") + 1) * 0.5).alias("ymin"), (105.5 + (F.col("c1") + 1) * 0.5).alias("xmax"), (21.25 - F.col("r0") * 0.5).alias("ymax"))


@query("WITH p AS (SELECT id, unnest([0, 1]) AS part, unnest([xmin, ymin]) AS v FROM boxes) SELECT id, CAST(part AS INT) AS part, v FROM p")
def geom_explode(t: Tables) -> DataFrame:
    return t.boxes.select("id", F.posexplode(F.array("xmin", "ymin")).alias("part", "v"))


@query("SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points")
def geom_drop_z(t: Tables) -> DataFrame:
    line = F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(7.0).alias("z")))
    flat = F.transform(line, lambda p: g.point(p["x"], p["y"]))
    return t.points.select("id", flat.alias("line")).select("id", F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))


@query("""WITH s AS (SELECT id, xmin, ymin, xmax, ymax, unnest(range(0, CAST(ceil((xmax - xmin) / 16.0) AS BIGINT))) AS i FROM boxes), u AS (SELECT s.*, j FROM s, unnest(range(0, CAST(ceil((ymax - ymin) / 16.0) AS BIGINT))) AS v(j))
SELECT id, i, j, CAST((least(xmin + (i + 1) * 16, xmax) - (xmin + i * 16)) * (least(ymin + (j + 1) * 16, ymax) - (ymin + j * 16)) AS BIGINT) AS area FROM u""")
def geom_grid_split(t: Tables) -> DataFrame:
    n = lambda a, b: F.sequence(F.lit(0).cast("long"), F.ceil((F.col(b) - F.col(a)) / 16.0) - 1)
    parts = t.boxes.where("xmax > xmin and ymax > ymin").select("*", F.explode(n("xmin", "xmax")).alias("i")).select("*", F.explode(n("ymin", "ymax")).alias("j"))
    side = lambda low, high, k: F.least(F.col(low) + (F.col(k) + 1) * 16, F.col(high)) - (F.col(low) + F.col(k) * 16)
    return parts.select("id", "i", "j", (side("xmin", "xmax", "i") * side("ymin", "ymax", "j")).cast("long").alias("area"))


@query("""WITH s AS (SELECT id, xmax - xmin AS w, ymax - ymin AS h FROM boxes WHERE xmax > xmin AND ymax > ymin), p AS (SELECT id, w, h, w + 2 * sqrt(w * w / 4.0 + h * h) AS per FROM s)
SELECT id, round(per / greatest(w, h), 6) AS elongation FROM p WHERE w * h / 2.0 > 20""")
def polygon_elongation(t: Tables) -> DataFrame:
    long_side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return triangles(t).where(g.area(F.col("ring")) > 20).select("id", F.round(g.perimeter(F.col("ring")) / long_side, 6).alias("elongation"))


@query("""SELECT id, CASE WHEN xmax > xmin AND ymax > ymin THEN true ELSE false END AS valid FROM boxes""")
def valid_geometry_filter(t: Tables) -> DataFrame:
    return triangles(t).select("id", g.valid(F.col("ring")).alias("valid"))


@query("SELECT id FROM boxes WHERE xmax - xmin >= 3")
def drop_short_rings(t: Tables) -> DataFrame:
    ring = F.transform(F.sequence(F.lit(1), F.greatest(F.col("xmax") - F.col("xmin"), F.lit(1))), lambda i: g.point(F.col("xmin") + i, F.col("ymin")))
    return t.boxes.withColumn("ring", ring).where(F.size("ring") >= 3).select("id")


@query("SELECT id, (xmax - xmin) * (ymax - ymin) / 2.0 AS area FROM boxes WHERE (xmax - xmin) * (ymax - ymin) / 2.0 > 150")
def filter_by_area(t: Tables) -> DataFrame:
    return triangles(t).select("id", g.area(F.col("ring")).alias("area")).where("area > 150")


_TILE = """WITH l AS (SELECT id, x * 0.36 - 180 AS lon, y * 0.16 - 80 AS lat FROM points), s AS (SELECT id, lon, lat, sin(radians(lat)) AS s FROM l),
p AS (SELECT id, lat, CAST(floor(floor(least(greatest((lon + 180) / 360 * 1048576 + 0.5, 0.0), 1048575.0)) / 256) AS INT) AS tx,
  CAST(floor(floor(least(greatest((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 1048576 + 0.5, 0.0), 1048575.0)) / 256) AS INT) AS ty FROM s)"""


@query(_TILE + """ SELECT id, tx, ty, CAST(4095 - ty AS INT) AS tms_y, array_to_string(list_transform(range(11, -1, -1), lambda i: ((tx >> CAST(i AS INT)) & 1) + 2 * ((ty >> CAST(i AS INT)) & 1)), '') AS quadkey,
tx AS back_x, ty AS back_y, round(cos(radians(lat)) * 2 * pi() * 6378137.0 / 1048576, 6) AS resolution FROM p""")
def tile_math(t: Tables) -> DataFrame:
    zoom = 12
    tx, ty = g.tile_of(F.col("lon"), F.col("lat"), zoom)
    at = t.points.select("id", (F.col("x") * 0.36 - 180).alias("lon"), (F.col("y") * 0.16 - 80).alias("lat")).withColumns({"tx": tx, "ty": ty}).withColumn("quadkey", g.quadkey(F.col("tx"), F.col("ty"), zoom))
    back_x, back_y = g.tile_of_quadkey(F.col("quadkey"))
    resolution = F.cos(F.radians("lat")) * 2 * F.pi() * g.EARTH / (256 << zoom)
    return at.select("id", "tx", "ty", ((1 << zoom) - 1 - F.col("ty")).alias("tms_y"), "quadkey", back_x.alias("back_x"), back_y.alias("back_y"), F.round(resolution, 6).alias("resolution"))


@query("""WITH s AS (SELECT id, unnest(range(xmin // 32, xmax // 32 + 1)) AS tx, ymin, ymax FROM boxes), u AS (SELECT id, tx, ty FROM s, unnest(range(ymin // 32, ymax // 32 + 1)) AS v(ty)) SELECT id, tx, ty FROM u""")
def tiles_covering(t: Tables) -> DataFrame:
    return spatial.in_cells(t.boxes, 32).select("id", F.col("gx").alias("tx"), F.col("gy").alias("ty"))


@query("""SELECT scene, round((year(acquired) - 1990) / 50.0, 6) AS y, round(month(acquired) / 12.0, 6) AS m, round(day(acquired) / 31.0, 6) AS d, round(hour(acquired) / 24.0, 6) AS h, round(minute(acquired) / 60.0, 6) AS mi FROM scenes""")
def embed_datetime(t: Tables) -> DataFrame:
    a = F.col("acquired")
    return t.scenes.select("scene", F.round((F.year(a) - 1990) / 50.0, 6).alias("y"), F.round(F.month(a) / 12.0, 6).alias("m"), F.round(F.dayofmonth(a) / 31.0, 6).alias("d"), F.round(F.hour(a) / 24.0, 6).alias("h"), F.round(F.minute(a) / 60.0, 6).alias("mi"))


@query("SELECT id, (xmin + xmax) / 2.0 AS cx, (ymin + ymax) / 2.0 AS cy, xmax - xmin AS w, ymax - ymin AS h FROM boxes")
def embed_box(t: Tables) -> DataFrame:
    return t.boxes.select("id", ((F.col("xmin") + F.col("xmax")) / 2.0).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2.0).alias("cy"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))


@query("SELECT id, CASE WHEN y * 0.16 - 80 >= 0 THEN '326' ELSE '327' END || lpad(CAST(CAST(floor(x * 0.36 / 6) % 60 + 1 AS INT) AS VARCHAR), 2, '0') AS epsg FROM points")
def utm_epsg(t: Tables) -> DataFrame:
    zone = (F.floor(F.col("x") * 0.36 / 6) % 60 + 1).cast("string")
    return t.points.select("id", F.concat(F.when(F.col("y") * 0.16 - 80 >= 0, "326").otherwise("327"), F.lpad(zone, 2, "0")).alias("epsg"))


@query("SELECT id, CAST(id * 7 % 256 AS INT) AS r, CAST(id * 13 % 256 AS INT) AS g, CAST(id * 29 % 256 AS INT) AS b, '#' || printf('%02x%02x%02x', id * 7 % 256, id * 13 % 256, id * 29 % 256) AS hex FROM points")
def hex_rgb(t: Tables) -> DataFrame:
    part = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    coded = t.points.select("id", F.concat(F.lit("#"), *[part((F.col("id") * k % 256).cast("long")) for k in (7, 13, 29)]).alias("hex"))
    byte = lambda i: F.conv(F.substring("hex", i, 2), 16, 10).cast("int")
    return coded.select("id", byte(2).alias("r"), byte(4).alias("g"), byte(6).alias("b"), "hex")


@query("""WITH v AS (SELECT scene_id, r, c, (b4 - b3) / nullif(CAST(b4 + b3 AS DOUBLE), 0) AS v FROM px4)
SELECT scene_id, r, c, CASE WHEN v > 0.8 THEN '#4CAF50' WHEN v > 0.6 THEN '#8BC34A' WHEN v > 0.4 THEN '#FFEB3B' WHEN v > 0.2 THEN '#FF9800' WHEN v > 0.0 THEN '#F44336' END AS colour FROM v""")
def pseudocolor(t: Tables) -> DataFrame:
    v = F.try_divide((F.col("b4") - F.col("b3")).cast("double"), (F.col("b4") + F.col("b3")).cast("double"))
    colour = F.lit(None).cast("string")
    for low, code in NDVI_LEGEND:
        colour = F.when(F.col("v") > low, code).otherwise(colour)
    return t.px4.select("scene_id", "r", "c", v.alias("v")).select("scene_id", "r", "c", colour.alias("colour"))


@query("WITH y AS (SELECT DISTINCT CAST(year(acquired) AS INT) AS y FROM scenes) SELECT y, CAST(y || '-04-01' AS DATE) AS first, CAST(y || '-09-30' AS DATE) AS last FROM y")
def season_ranges(t: Tables) -> DataFrame:
    day = lambda d: F.to_date(F.concat(F.col("y").cast("string"), F.lit(d)))
    return t.scenes.select(F.year("acquired").alias("y")).distinct().select("y", day("-04-01").alias("first"), day("-09-30").alias("last"))


@query("SELECT scene, last_day(CAST(acquired AS DATE)) AS month_end FROM scenes")
def month_end(t: Tables) -> DataFrame:
    return t.scenes.select("scene", F.last_day(F.col("acquired").cast("date")).alias("month_end"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, CAST(len(w) AS INT) AS n, array_to_string(list_append(w, '</s>'), ' ') AS tokens FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)")
def text_tokens(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    return w.select("conv_id", "turn", F.size("w").alias("n"), F.array_join(F.array_append("w", F.lit("</s>")), " ").alias("tokens"))


@query(" UNION ALL ".join(f"(SELECT {n} AS n, g, count(*) AS times FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT {_WORDS} AS w FROM benchmark)) GROUP BY 1, 2)" for n in range(1, 5)))
def text_ngrams(t: Tables) -> DataFrame:
    w = t.benchmark.select(text.tokens(F.col("text")).alias("w"))
    sized = lambda n: F.transform(text.ngrams(F.col("w"), n), lambda x: F.struct(F.lit(n).alias("n"), x.alias("g")))
    return w.select(F.explode(F.flatten(F.array(*[sized(n) for n in range(1, 5)]))).alias("e")).groupBy("e.n", "e.g").agg(F.count("*").alias("times"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[[:punct:]]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM conversations")
def text_normalize_answer(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(text.normal_answer(F.col("text")), " ").alias("answer"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def text_normalize_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normal_space(F.col("text")).alias("text"))


# -- regions


@query("""WITH RECURSIVE m AS (SELECT r, c FROM cls_before WHERE cls = 1), e AS (SELECT a.r * 1000 + a.c AS u, b.r * 1000 + b.c AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
w AS (SELECT r * 1000 + c AS node, r * 1000 + c AS root FROM m UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.node),
l AS (SELECT node, min(root) AS root FROM w GROUP BY 1) SELECT CAST(node // 1000 AS INT) AS r, CAST(node % 1000 AS INT) AS c, CAST(root // 1000 AS INT) AS root_r, CAST(root % 1000 AS INT) AS root_c FROM l""")
def connected_components(t: Tables) -> DataFrame:
    found = detections.regions(t.cls_before.where("cls = 1"))
    return found.select("r", "c", F.shiftright("region", 32).cast("int").alias("root_r"), F.col("region").bitwiseAND((1 << 32) - 1).cast("int").alias("root_c"))


@query()
def remove_small_regions(t: Tables) -> DataFrame:
    found = detections.regions(t.cls_before)
    large = found.groupBy("region").agg(F.count("*").alias("n")).where("n > 3").select("region")
    return found.join(large, "region", "left_semi").select("r", "c", "cls")


@query()
def raster_to_regions(t: Tables) -> DataFrame:
    return learned.region_table(detections.regions(raster.change(t.cls_before, t.cls_after, 1).where("change <> 0"), "change"), "change", {1: "Green to Non", 2: "Non to Green"})


# -- learned


@query()
def zoning_kmeans(t: Tables) -> DataFrame:
    """Five zones of every scene."""
    return learned.zoned(t.px, ["scene_id"], "b1", 5)


@query()
def height_kmeans(t: Tables) -> DataFrame:
    """Three clusters of the heights of each scene and five of each of its tiles; heights up to 5 are ground."""
    tall = t.px.where("b1 > 5").withColumns({"tr": F.floor(F.col("r") / 25).cast("int"), "tc": F.floor(F.col("c") / 25).cast("int")})
    tiled = learned.zoned(tall, ["scene_id", "tr", "tc"], "b1", 5, name="tile_zone")
    return learned.zoned(tiled, ["scene_id"], "b1", 3)


@query()
def height_mask(t: Tables) -> DataFrame:
    """What stands above 5, by three clusters of each scene and by five of each of its tiles."""
    tiled = t.px.select("scene_id", "r", "c", "b1", F.floor(F.col("r") / 25).cast("int").alias("tr"), F.floor(F.col("c") / 25).cast("int").alias("tc"))
    whole = learned.tall(tiled, ["scene_id"], "b1", 3, 5)
    return learned.tall(whole, ["scene_id", "tr", "tc"], "b1", 5, 5, name="tall_in_tile")


@query()
def anchor_kmeans(t: Tables) -> DataFrame:
    return learned.anchors(t.boxes, 9)


@query("""WITH d AS (SELECT a.r, a.c, sqrt(power(a.b1 - n.b1, 2) + power(a.b2 - n.b2, 2)) AS d FROM px a JOIN px n ON n.r = a.r AND n.c = a.c WHERE a.scene_id = 'A' AND n.scene_id = 'N'), p AS (SELECT quantile_cont(d, 0.95) AS p FROM d),
m AS (SELECT r, c, d, CASE WHEN d >= p THEN 1 ELSE 0 END AS cls FROM d CROSS JOIN p), near AS (SELECT x AS dr, y AS dc FROM (SELECT unnest([-1, 0, 1]) AS x) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS y)),
o1 AS (SELECT m.r, m.c, min(n.cls) AS cls FROM m JOIN (SELECT r + dr AS r, c + dc AS c, cls FROM m CROSS JOIN near) n ON n.r = m.r AND n.c = m.c GROUP BY 1, 2),
o2 AS (SELECT m.r, m.c, max(n.cls) AS cls FROM o1 m JOIN (SELECT r + dr AS r, c + dc AS c, cls FROM o1 CROSS JOIN near) n ON n.r = m.r AND n.c = m.c GROUP BY 1, 2),
o3 AS (SELECT m.r, m.c, max(n.cls) AS cls FROM o2 m JOIN (SELECT r + dr AS r, c + dc AS c, cls FROM o2 CROSS JOIN near) n ON n.r = m.r AND n.c = m.c GROUP BY 1, 2),
o4 AS (SELECT m.r, m.c, min(n.cls) AS cls FROM o3 m JOIN (SELECT r + dr AS r, c + dc AS c, cls FROM o3 CROSS JOIN near) n ON n.r = m.r AND n.c = m.c GROUP BY 1, 2)
SELECT m.r, m.c, round(d, 6) AS d, m.cls AS change, o4.cls AS cleaned FROM m JOIN o4 ON o4.r = m.r AND o4.c = m.c""")
def unsupervised_change(t: Tables) -> DataFrame:
    a, n = (t.px.where(f"scene_id = '{s}'").select("r", "c", F.col("b1").alias(f"{s}1"), F.col("b2").alias(f"{s}2")) for s in "AN")
    d = a.join(n, ["r", "c"]).select("r", "c", F.sqrt(F.pow(F.col("A1") - F.col("N1"), 2) + F.pow(F.col("A2") - F.col("N2"), 2)).alias("d"))
    d = written(d, "distances")
    mask = d.withColumn("cls", (F.col("d") >= F.lit(orders.quantile(d, "d", 0.95))).cast("int"))
    cleaned = raster.closing(raster.opening(mask, raster.kernel(3)), raster.kernel(3)).withColumnRenamed("cls", "cleaned")
    return mask.join(cleaned, ["r", "c"]).select("r", "c", F.round("d", 6).alias("d"), F.col("cls").alias("change"), "cleaned")


@query()
def pixel_classifier(t: Tables) -> DataFrame:
    return learned.classified(t.px4.withColumn("label", (F.col("b1") > F.col("b3")).cast("int")), ["b1", "b2", "b3", "b4"], "label")


@query()
def feature_kmeans(t: Tables) -> DataFrame:
    return learned.codebook(t.embeddings, "vec_id", "embedding", 8)


@query()
def whitening(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    pairs = v.alias("a").join(v.alias("b"), (F.col("a.vec_id") + 1 == F.col("b.vec_id"))).select(F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    mean, projection = vectors.whitening(pairs, "x", "y")
    return vectors.whitened(v.select("vec_id", "v"), "v", mean, projection, 16).select("vec_id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("""SELECT scene_id, r // 10 AS tr, c // 10 AS tc, CASE WHEN stddev_pop(b1 * 5) > 75 THEN 'outlier' WHEN avg(b1 * 5) <= 90 THEN 'dark' WHEN avg(b1 * 5) <= 130 THEN 'middle' ELSE 'bright' END AS grp FROM px GROUP BY 1, 2, 3""")
def histogram_group(t: Tables) -> DataFrame:
    v = F.col("b1") * 5
    tiles = t.px.groupBy("scene_id", F.floor(F.col("r") / 10).cast("int").alias("tr"), F.floor(F.col("c") / 10).cast("int").alias("tc")).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    return tiles.select("scene_id", "tr", "tc", F.when(F.col("s") > 75, "outlier").when(F.col("m") <= 90, "dark").when(F.col("m") <= 130, "middle").otherwise("bright").alias("grp"))
