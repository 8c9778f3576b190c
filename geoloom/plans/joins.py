"""Joins of layers, boxes, rasters, catalogues and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_ring, contains
from ..operators import boxlists, grids, hierarchies, orders, raster, spatial
from ..scratch import written
from .base import Tables, query

_TOUCH = "l.xmin < r.xmax AND r.xmin < l.xmax AND l.ymin < r.ymax AND r.ymin < l.ymax"


@query(f"SELECT l.id AS left_id, r.id AS right_id FROM boxes l JOIN truths r ON {_TOUCH} WHERE l.score > 1000")
def spatial_join(t: Tables) -> DataFrame:
    return spatial.box_pairs(spatial.dealt(t.boxes.where("score > 1000"), "id"), spatial.dealt(t.truths, "id"), 64).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


@query(f"""SELECT l.id, count(*) AS n, arg_min(r.id, r.id) AS first, arg_max(r.id, r.id) AS last, min(r.xmin) AS low, max(r.xmax) AS high, round(avg(r.xmin), 6) AS mean, CAST(sum(r.xmin) AS BIGINT) AS total,
  string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) AS joined, round(stddev_samp(r.xmin), 6) AS deviation FROM boxes l JOIN truths r ON {_TOUCH} GROUP BY 1""")
def spatial_join_one_to_one(t: Tables) -> DataFrame:
    """Boxes of an id of their own get what overlaps them in one task, without a row for each pair; those that share one are grouped."""
    counted = written(t.boxes.withColumn("_n", F.count("*").over(Window.partitionBy("id"))), "boxes")
    merged = boxlists.merged_boxes(counted.where("_n = 1"), t.truths, ["xmin", "xmax"], 32)
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("xmin_apart") / (F.col("n") - 1)))
    alone = merged.select(
        "id", "n", "first", "last", F.col("xmin_low").cast("int").alias("low"), F.col("xmax_high").cast("int").alias("high"),
        F.round(F.col("xmin_total") / F.col("n"), 6).alias("mean"), F.col("xmin_total").alias("total"), "joined", F.round(deviation, 6).alias("deviation"),
    )
    x = F.col("r.xmin")
    shared = spatial.box_pairs(counted.where("_n > 1"), t.truths, 64).groupBy(F.col("l.id").alias("id")).agg(
        F.count("*").alias("n"), F.min("r.id").alias("first"), F.max("r.id").alias("last"), F.min(x).alias("low"), F.max("r.xmax").alias("high"),
        F.round(F.avg(x), 6).alias("mean"), F.sum(x).alias("total"), F.array_join(F.transform(F.sort_array(F.collect_list("r.id")), lambda i: i.cast("string")), ",").alias("joined"), F.round(F.stddev_samp(x), 6).alias("deviation"),
    )
    return alone.unionByName(shared)


_NEAR = "power(greatest(b.xmin - p.x, p.x - b.xmax, 0), 2) + power(greatest(b.ymin - p.y, p.y - b.ymax, 0), 2) <= 25"


@query(f"WITH m AS (SELECT b.id, min(p.id) AS point FROM boxes b JOIN points p ON {_NEAR} GROUP BY 1) SELECT b.id, m.point FROM boxes b LEFT JOIN m ON m.id = b.id")
def buffer_join_first(t: Tables) -> DataFrame:
    # Of points on one place only the first can be a box's.
    places = t.points.groupBy("x", "y").agg(F.min("id").alias("id"))
    first = spatial.within_distance(t.boxes, places, 5, 16).groupBy(F.col("l.id").alias("id")).agg(F.min("r.id").alias("point"))
    return t.boxes.select("id").join(first, "id", "left")


@query("SELECT p.id AS point, b.id AS box FROM points p JOIN boxes b ON p.x >= b.xmin AND p.x < b.xmax AND p.y >= b.ymin AND p.y < b.ymax")
def point_in_polygon_join(t: Tables) -> DataFrame:
    """Points on one place lie in the same boxes: a place is looked at once, and its points join what holds it."""
    ring = box_ring(*(F.col(s) for s in spatial.SIDES))
    places = spatial.dealt(t.points.select("x", "y").distinct(), "x", "y")
    boxes = spatial.dealt(t.boxes.select(*spatial.SIDES, ring.alias("ring"), F.col("id").alias("box")), "box")
    held = spatial.points_in_boxes(places.hint("merge"), "x", "y", boxes, 16)
    inside = held.where(contains(F.col("ring"), F.col("x").cast("double"), F.col("y").cast("double"))).select("x", "y", "box")
    return spatial.dealt(inside, "box").join(t.points, ["x", "y"]).select(F.col("id").alias("point"), "box")


_CUT = "greatest(l.xmin, r.xmin) AS xmin, greatest(l.ymin, r.ymin) AS ymin, least(l.xmax, r.xmax) AS xmax, least(l.ymax, r.ymax) AS ymax"


@query(f"WITH c AS (SELECT l.id AS a, r.id AS b, {_CUT} FROM boxes l JOIN truths r ON {_TOUCH}) SELECT *, CAST((xmax - xmin) * (ymax - ymin) AS BIGINT) AS area FROM c WHERE (xmax - xmin) * (ymax - ymin) > 20")
def overlay_intersection(t: Tables) -> DataFrame:
    cut = spatial.intersection()
    pairs = spatial.box_pairs(spatial.dealt(t.boxes, "id"), spatial.dealt(t.truths, "id"), 64)
    return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), *[v.alias(k) for k, v in cut.items()], spatial.box_area(cut).cast("long").alias("area")).where("area > 20")


_COVER = "SELECT DISTINCT img, x, y FROM (SELECT img, unnest(range(xmin // 4, xmax // 4 + 1)) AS x, ymin, ymax FROM {}) s, unnest(range(ymin // 4, ymax // 4 + 1)) AS u(y)"


@query(f"WITH a AS ({_COVER.format('boxes')}), b AS ({_COVER.format('truths')}) SELECT img, count(*) AS cells FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.img = a.img AND b.x = a.x AND b.y = a.y) GROUP BY 1")
def overlay_difference(t: Tables) -> DataFrame:
    cover = lambda d: spatial.in_cells(d, 4).select("img", "gx", "gy").distinct()
    return cover(t.boxes).join(cover(t.truths), ["img", "gx", "gy"], "left_anti").groupBy("img").agg(F.count("*").alias("cells"))


@query(f"SELECT l.id, r.zone, {_CUT} FROM boxes l JOIN zones r ON {_TOUCH}")
def clip_vector(t: Tables) -> DataFrame:
    return spatial.box_pairs(spatial.dealt(t.boxes, "id"), t.zones, 64).select(F.col("l.id").alias("id"), F.col("r.zone").alias("zone"), *[v.alias(k) for k, v in spatial.intersection().items()])


@query("""WITH s AS (SELECT id, unnest(range(xmin // 50, (xmax - 1) // 50 + 1)) AS tx, xmin, ymin, xmax, ymax FROM boxes), u AS (SELECT s.*, y.ty FROM s, unnest(range(ymin // 50, (ymax - 1) // 50 + 1)) AS y(ty))
SELECT id, tx, ty, CAST(greatest(xmin, tx * 50) AS BIGINT) AS xmin, CAST(greatest(ymin, ty * 50) AS BIGINT) AS ymin, CAST(least(xmax, tx * 50 + 50) AS BIGINT) AS xmax, CAST(least(ymax, ty * 50 + 50) AS BIGINT) AS ymax FROM u""")
def clip_layer_per_tile(t: Tables) -> DataFrame:
    tiles = spatial.in_cells(t.boxes, 50)
    low = lambda c, g: F.greatest(F.col(c), F.col(g) * 50).cast("long").alias(c)
    high = lambda c, g: F.least(F.col(c), F.col(g) * 50 + 50).cast("long").alias(c)
    return tiles.select("id", F.col("gx").alias("tx"), F.col("gy").alias("ty"), low("xmin", "gx"), low("ymin", "gy"), high("xmax", "gx"), high("ymax", "gy")).where("xmin < xmax and ymin < ymax")


@query("SELECT scene_id, r, c, b1 FROM px WHERE EXISTS (SELECT 1 FROM zones WHERE zone < 'NATION_15' AND c >= xmin AND c < xmax AND r >= ymin AND r < ymax)")
def clip_raster_by_aoi(t: Tables) -> DataFrame:
    aoi = spatial.in_cells(t.zones.where("zone < 'NATION_15'"), 20)
    on = (F.floor(F.col("c") / 20) == F.col("gx")) & (F.floor(F.col("r") / 20) == F.col("gy")) & (F.col("c") >= F.col("xmin")) & (F.col("c") < F.col("xmax")) & (F.col("r") >= F.col("ymin")) & (F.col("r") < F.col("ymax"))
    return t.px.select("scene_id", "r", "c", "b1").join(aoi, on, "left_semi")


@query("WITH s AS (SELECT DISTINCT xmin, ymin, xmax, ymax FROM truths) SELECT xmin, ymin, xmax, ymax, count(*) AS cells, CAST(sum(b1) AS BIGINT) AS total FROM px JOIN s ON c >= xmin AND c < xmax AND r >= ymin AND r < ymax GROUP BY 1, 2, 3, 4")
def crop_by_boxes(t: Tables) -> DataFrame:
    shapes = t.truths.select(*spatial.SIDES).distinct()
    return spatial.points_in_boxes(t.px, "c", "r", shapes, 20).groupBy(*spatial.SIDES).agg(F.count("*").alias("cells"), F.sum("b1").alias("total"))


@query("""WITH d AS (SELECT img, xmin, ymin, xmax, ymax, min(id) AS id FROM boxes GROUP BY 1, 2, 3, 4, 5)
SELECT a.id AS inner_id, b.id AS outer_id FROM d a JOIN d b ON a.img = b.img AND a.id <> b.id AND a.xmin >= b.xmin AND a.ymin >= b.ymin AND a.xmax <= b.xmax AND a.ymax <= b.ymax""")
def box_containment(t: Tables) -> DataFrame:
    d = t.boxes.groupBy("img", *spatial.SIDES).agg(F.min("id").alias("id"))
    inside = (F.col("l.xmin") >= F.col("r.xmin")) & (F.col("l.ymin") >= F.col("r.ymin")) & (F.col("l.xmax") <= F.col("r.xmax")) & (F.col("l.ymax") <= F.col("r.ymax"))
    return spatial.box_pairs(d, d, 64, by=["img"]).where((F.col("l.id") != F.col("r.id")) & inside).select(F.col("l.id").alias("inner_id"), F.col("r.id").alias("outer_id"))


@query("SELECT DISTINCT p.r, p.c, arg_max(t.id % 7 + 1, t.id) AS value FROM (SELECT DISTINCT r, c FROM px) p JOIN truths t ON p.c >= t.xmin AND p.c < t.xmax AND p.r >= t.ymin AND p.r < t.ymax GROUP BY 1, 2")
def rasterize_zones(t: Tables) -> DataFrame:
    cells = t.px.select("r", "c").distinct()
    return spatial.points_in_boxes(cells, "c", "r", t.truths, 20).groupBy("r", "c").agg(F.max_by(F.col("id") % 7 + 1, "id").alias("value"))


@query("SELECT p.id, scene_id, b1, b2 FROM points p JOIN px ON px.r = p.y // 10 AND px.c = p.x // 10")
def raster_point_inspect(t: Tables) -> DataFrame:
    at = t.points.select("id", F.floor(F.col("y") / 10).cast("int").alias("r"), F.floor(F.col("x") / 10).cast("int").alias("c"))
    return at.join(t.px, ["r", "c"]).select("id", "scene_id", "b1", "b2")


@query("""WITH l AS (SELECT 'boxes' AS layer, id, xmin, ymin, xmax, ymax FROM boxes UNION ALL SELECT 'truths', id, xmin, ymin, xmax, ymax FROM truths)
SELECT p.id AS point, l.layer, min(l.id) AS feature FROM points p JOIN l ON power(greatest(l.xmin - p.x, p.x - l.xmax, 0), 2) + power(greatest(l.ymin - p.y, p.y - l.ymax, 0), 2) <= 25 GROUP BY 1, 2""")
def vector_point_inspect(t: Tables) -> DataFrame:
    """Points on one place have the same answer: a place is looked at once, and its points join the answer."""
    layers = t.boxes.select(F.lit("boxes").alias("layer"), "id", *spatial.SIDES).union(t.truths.select(F.lit("truths"), "id", *spatial.SIDES))
    near = spatial.within_distance(layers, t.points.select("x", "y").distinct(), 5, 16)
    found = near.groupBy(F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("l.layer").alias("layer")).agg(F.min("l.id").alias("feature"))
    return t.points.join(found, ["x", "y"]).select(F.col("id").alias("point"), "layer", "feature")


_BOTH = "cls_before b FULL JOIN cls_after a ON a.r = b.r AND a.c = b.c"


@query(f"SELECT coalesce(b.r, a.r) AS r, coalesce(b.c, a.c) AS c, CASE WHEN b.cls = 1 AND coalesce(a.cls, 0) <> 1 THEN 1 WHEN coalesce(b.cls, 0) <> 1 AND a.cls = 1 THEN 2 ELSE 0 END AS change FROM {_BOTH}")
def two_date_change(t: Tables) -> DataFrame:
    return raster.change(t.cls_before, t.cls_after, 1)


@query("SELECT b.r, b.c, CASE WHEN b.cls IN (1, 2) AND a.cls IN (3) THEN 1 ELSE 0 END AS code FROM cls_before b JOIN cls_after a ON a.r = b.r AND a.c = b.c")
def transition_change(t: Tables) -> DataFrame:
    return raster.transition(t.cls_before, t.cls_after, [1, 2], [3])


@query("SELECT b.r, b.c, CASE WHEN b.b1 <> 0 AND a.b1 <> 0 THEN a.b1 - b.b1 ELSE 0 END AS diff FROM px b JOIN px a ON a.r = b.r AND a.c = b.c WHERE b.scene_id = 'A' AND a.scene_id = 'N'")
def value_difference(t: Tables) -> DataFrame:
    return raster.difference(t.px.where("scene_id = 'A'"), t.px.where("scene_id = 'N'"), "b1")


@query("SELECT r, c, cls FROM cls_before b WHERE cls = 1 AND NOT EXISTS (SELECT 1 FROM cls_after a WHERE a.cls = 1 AND a.r = b.r AND a.c = b.c)")
def mask_subtract(t: Tables) -> DataFrame:
    return raster.subtract(t.cls_before.where("cls = 1"), t.cls_after.where("cls = 1"))


_MONTHS = "m AS (SELECT CAST(o_orderkey % 30 AS INT) AS r, CAST(o_custkey % 30 AS INT) AS c, strftime(o_orderdate, '%Y-%m') AS month, CAST(max(o_orderkey) % 6 AS INT) AS cls FROM orders GROUP BY 1, 2, 3)"


@query(f"WITH {_MONTHS} SELECT r, c, month, cls, coalesce(last_value(CASE WHEN cls <> 5 THEN cls END IGNORE NULLS) OVER (PARTITION BY r, c ORDER BY month ROWS UNBOUNDED PRECEDING), cls) AS filled FROM m")
def gap_fill_previous(t: Tables) -> DataFrame:
    m = t.orders.groupBy((F.col("o_orderkey") % 30).cast("int").alias("r"), (F.col("o_custkey") % 30).cast("int").alias("c"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.max("o_orderkey") % 6).cast("int").alias("cls"))
    return raster.gap_fill(m, "month", "cls", 5)


@query("""WITH g AS (SELECT DISTINCT r * 2 AS tr, c * 2 AS tc FROM cls_after WHERE r < 49 AND c < 49), s AS (SELECT r, c, b1 FROM px WHERE scene_id = 'N')
SELECT tr, tc, round(sum(b1 * w) / sum(w), 6) AS b1 FROM (SELECT tr, tc, s.b1, (1 - abs(s.r - (tr + 0.25))) * (1 - abs(s.c - (tc + 0.25))) AS w FROM g JOIN s ON s.r BETWEEN tr AND tr + 1 AND s.c BETWEEN tc AND tc + 1) GROUP BY 1, 2""")
def align_to_grid(t: Tables) -> DataFrame:
    grid = t.cls_after.where("r < 49 and c < 49").select((F.col("r") * 2).alias("tr"), (F.col("c") * 2).alias("tc")).distinct()
    near = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(abs(1 - y - 0.25) * abs(1 - x - 0.25)).alias("w")) for y in (0, 1) for x in (0, 1)]))
    four = grid.withColumn("n", near).select("tr", "tc", (F.col("tr") + F.col("n.y")).alias("r"), (F.col("tc") + F.col("n.x")).alias("c"), "n.w")
    return four.join(t.px.where("scene_id = 'N'").select("r", "c", "b1"), ["r", "c"]).groupBy("tr", "tc").agg(F.round(F.sum(F.col("b1") * F.col("w")) / F.sum("w"), 6).alias("b1"))


@query("SELECT r, c, max(CASE WHEN scene_id = 'A' THEN b1 END) AS a, max(CASE WHEN scene_id = 'N' THEN b1 END) AS n, max(CASE WHEN scene_id = 'R' THEN b1 END) AS r_band FROM px GROUP BY 1, 2")
def band_stack(t: Tables) -> DataFrame:
    band = lambda scene, name: F.max(F.when(F.col("scene_id") == scene, F.col("b1"))).alias(name)
    return t.px.groupBy("r", "c").agg(band("A", "a"), band("N", "n"), band("R", "r_band"))


@query("""WITH b AS (SELECT scene_id, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1 FROM px WHERE b1 > 25 GROUP BY 1)
SELECT x.scene_id AS a, y.scene_id AS b, greatest(x.r0, y.r0) AS r0, greatest(x.c0, y.c0) AS c0, least(x.r1, y.r1) AS r1, least(x.c1, y.c1) AS c1 FROM b x JOIN b y ON x.scene_id < y.scene_id""")
def bbox_intersection(t: Tables) -> DataFrame:
    b = t.px.where("b1 > 25").groupBy("scene_id").agg(F.min("r").alias("ymin"), F.min("c").alias("xmin"), F.max("r").alias("ymax"), F.max("c").alias("xmax"))
    cut = spatial.intersection()
    both = spatial.box_pairs(b, b, 64, touching=True).where("l.scene_id < r.scene_id")
    return both.select(F.col("l.scene_id").alias("a"), F.col("r.scene_id").alias("b"), cut["ymin"].alias("r0"), cut["xmin"].alias("c0"), cut["ymax"].alias("r1"), cut["xmax"].alias("c1"))


@query(f"""WITH a AS (SELECT l.id, sum((least(l.xmax, r.xmax) - greatest(l.xmin, r.xmin)) * (least(l.ymax, r.ymax) - greatest(l.ymin, r.ymin))) AS area FROM boxes l JOIN truths r ON {_TOUCH} GROUP BY 1)
SELECT id FROM a WHERE area > 75 AND NOT EXISTS (SELECT 1 FROM boxes l JOIN zones r ON {_TOUCH} WHERE l.id = a.id AND r.zone = 'NATION_3')""")
def grid_semi_join(t: Tables) -> DataFrame:
    area = spatial.box_area(spatial.intersection())
    # Shares only add up, so a box is wanted as soon as a few truths of every cell are enough; only the others meet all.
    cell = Window.partitionBy(F.floor(F.col("xmin") / 16), F.floor(F.col("ymin") / 16)).orderBy("id")
    truths = t.truths.select("*", F.row_number().over(cell).alias("nth"))
    left, found = spatial.dealt(t.boxes.select("id", *spatial.SIDES), "id"), []
    for most in (4, 64, None):
        pairs = spatial.box_pairs(left, truths if most is None else truths.where(F.col("nth") <= most), 64)
        found.append(written(pairs.groupBy(F.col("l.id").alias("id")).agg(F.sum(area).alias("area")).where("area > 75").select("id"), "wanted"))
        left = left.join(found[-1], "id", "left_anti")
    wanted = reduce(DataFrame.union, found)
    barred = spatial.box_pairs(spatial.dealt(t.boxes, "id"), t.zones.where("zone = 'NATION_3'"), 64).select(F.col("l.id").alias("id"))
    return wanted.join(barred, "id", "left_anti")


@query("""SELECT p.page_id, o.o_orderkey, e.event_id FROM (SELECT page_id, CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS k FROM pages WHERE regexp_matches(url, '[0-9]+')) p
JOIN orders o ON o.o_orderkey = p.k JOIN events e ON e.event_id = p.k""")
def match_by_name(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.regexp_extract("url", "([0-9]+)", 1).alias("k")).where("k <> ''").select("page_id", F.col("k").cast("long").alias("k"))
    return p.join(t.orders.select("o_orderkey"), F.col("k") == F.col("o_orderkey")).join(t.events.select("event_id"), F.col("k") == F.col("event_id")).select("page_id", "o_orderkey", "event_id")


@query("""WITH done AS (SELECT l_orderkey AS k, max(l_shipdate) AS made FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), old AS (SELECT k FROM done WHERE k <> (SELECT arg_max(k, (made, k)) FROM done))
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM old WHERE k = o_orderkey)""")
def skip_processed(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("made"))
    newest = done.agg(F.max_by("k", F.struct("made", "k")).alias("k"))  # one row, made anew as it may be incomplete
    return t.orders.select("o_orderkey").join(done.join(F.broadcast(newest), "k", "left_anti"), F.col("o_orderkey") == F.col("k"), "left_anti")


@query("SELECT user_id, item_id, rating, p_name AS title, p_type AS genre FROM ratings JOIN part ON p_partkey = item_id")
def ratings_join_items(t: Tables) -> DataFrame:
    return t.ratings.join(t.part, F.col("p_partkey") == F.col("item_id")).select("user_id", "item_id", "rating", F.col("p_name").alias("title"), F.col("p_type").alias("genre"))


_URL = r"regexp_replace(regexp_replace({}, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH a AS (SELECT page_id, {_URL.format('url')} AS k, length(html) AS size FROM pages), s AS (SELECT page_id % 50 AS story, page_id AS pos, {_URL.format("url || '?utm=1'")} AS k FROM pages),
j AS (SELECT story, pos, a.page_id, size, row_number() OVER (PARTITION BY story ORDER BY pos, a.page_id) AS n FROM s JOIN a ON a.k = s.k)
SELECT story, max(CASE WHEN n = 1 THEN size ELSE 0 END) AS s1, max(CASE WHEN n = 2 THEN size ELSE 0 END) AS s2, max(CASE WHEN n = 3 THEN size ELSE 0 END) AS s3 FROM j WHERE n <= 3 GROUP BY 1""")
def stories_join_articles(t: Tables) -> DataFrame:
    key = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z]+://", ""), "[?#].*$", "")
    articles = t.pages.select("page_id", key(F.col("url")).alias("k"), F.length("html").cast("long").alias("size"))
    stories = t.pages.select((F.col("page_id") % 50).alias("story"), F.col("page_id").alias("pos"), key(F.concat("url", F.lit("?utm=1"))).alias("k"))
    n = F.row_number().over(Window.partitionBy("story").orderBy("pos", "page_id"))
    j = stories.join(articles, "k").withColumn("n", n).where("n <= 3")
    slot = lambda i: F.max(F.when(F.col("n") == i, F.col("size")).otherwise(0)).alias(f"s{i}")
    return j.groupBy("story").agg(slot(1), slot(2), slot(3))


@query("""WITH v AS (SELECT p_brand AS val, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS INT) AS id FROM part WHERE p_size > 25 GROUP BY 1 HAVING count(*) > 30)
SELECT p_partkey, coalesce(id, -1) AS brand_id FROM part LEFT JOIN v ON val = p_brand""")
def vocab_apply(t: Tables) -> DataFrame:
    n = t.part.where("p_size > 25").groupBy(F.col("p_brand").alias("val")).agg(F.count("*").alias("n")).where("n > 30")
    v = orders.running(n, [F.desc("n"), F.col("val").asc()]).select("val", F.col("_rank").cast("int").alias("id"))
    return t.part.join(v, F.col("p_brand") == F.col("val"), "left").select("p_partkey", F.coalesce("id", F.lit(-1)).alias("brand_id"))


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS node, n_nationkey AS anc FROM nation UNION ALL SELECT node, anc // 3 FROM up WHERE anc > 0)
SELECT s_suppkey, anc AS label FROM supplier JOIN up ON node = s_nationkey""")
def hierarchy_expand(t: Tables) -> DataFrame:
    # A nation's parent is its key divided by three; the closure of this small tree is a recursive query.
    closure = t.spark.sql("WITH RECURSIVE up(node, anc) AS (SELECT n_nationkey, n_nationkey FROM {nation} UNION ALL SELECT node, CAST(anc div 3 AS INT) FROM up WHERE anc > 0) SELECT node, anc FROM up", nation=t.nation)
    return t.supplier.join(closure, F.col("node") == F.col("s_nationkey")).select("s_suppkey", F.col("anc").alias("label"))


_TREE = "t AS (SELECT n_nationkey AS child, n_nationkey // 3 AS parent FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey // 5 FROM nation WHERE n_nationkey > 0)"


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT child, parent FROM t UNION SELECT up.child, t.parent FROM up JOIN t ON t.child = up.parent), l AS (SELECT s_suppkey, s_nationkey AS label, s_suppkey % 3 <> 0 AS present FROM supplier)
SELECT * FROM l UNION ALL SELECT s_suppkey, parent, present FROM l JOIN up ON child = label WHERE present UNION ALL SELECT s_suppkey, child, present FROM l JOIN up ON parent = label WHERE NOT present""")
def hierarchy_expand_labels(t: Tables) -> DataFrame:
    """Labels that are there go to all ancestors, labels that are missing to all descendants; a node has up to two parents."""
    parent = lambda k: t.nation.where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("child"), F.floor(F.col("n_nationkey") / k).alias("parent"))
    labels = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("label"), (F.col("s_suppkey") % 3 != 0).alias("present"))
    return hierarchies.expand(labels, parent(3).union(parent(5)), "label", positive="present")


# Two grids of other origin and cell size: scenes on unit cells, the target on cells of 0.7 x 1.3 from (3.2, 1.1).
_CENTRES = "g AS (SELECT a.r, b.c, 1.1 + (a.r + 0.5) * 1.3 - 0.5 AS sr, 3.2 + (b.c + 0.5) * 0.7 - 0.5 AS sc FROM (SELECT CAST(unnest(range(0, 80)) AS INT) AS r) a CROSS JOIN (SELECT CAST(unnest(range(0, 150)) AS INT) AS c) b)"


@query(f"""WITH {_CENTRES}, w AS (SELECT scene_id, g.r, g.c, px.b1, (1 - abs(sr - px.r)) * (1 - abs(sc - px.c)) AS w FROM g JOIN px ON px.r BETWEEN floor(sr) AND floor(sr) + 1 AND px.c BETWEEN floor(sc) AND floor(sc) + 1 WHERE b1 <> 1)
SELECT scene_id, r, c, round(sum(b1 * w) / sum(w), 6) AS b1 FROM w WHERE w > 0 GROUP BY 1, 2, 3""")
def align_bilinear(t: Tables) -> DataFrame:
    onto = grids.Grid(3.2, 0.7, 1.1, 1.3)
    found = grids.align(t.px, grids.Grid(0.0, 1.0, 0.0, 1.0), onto.cells(t.spark, 80, 150), onto, "b1", nodata=1, by=["scene_id"])
    return found.select("scene_id", "r", "c", F.round("b1", 6).alias("b1"))


@query(f"WITH {_CENTRES} SELECT scene_id, g.r, g.c, CAST(px.b1 AS DOUBLE) AS b1 FROM g JOIN px ON px.r = floor(sr + 0.5) AND px.c = floor(sc + 0.5) WHERE b1 <> 1")
def align_nearest(t: Tables) -> DataFrame:
    onto = grids.Grid(3.2, 0.7, 1.1, 1.3)
    return grids.align(t.px, grids.Grid(0.0, 1.0, 0.0, 1.0), onto.cells(t.spark, 80, 150), onto, "b1", method="nearest", nodata=1, by=["scene_id"])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS q, x.vec_id AS id, round(list_inner_product(q.v, x.v), 6) AS dot FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY dot DESC, id) AS INTEGER) AS rank FROM s) SELECT q, id, dot, rank FROM r WHERE rank <= 3""")
def similarity_topk(t: Tables) -> DataFrame:
    from ..operators.vectors import dot_topk

    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return dot_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 3)


