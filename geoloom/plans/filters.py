"""Projections, filters and predicates over pixels, scenes and click logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import EIGHT_BAND_INDICES, EIGHT_BANDS, avi, evi, expression, index, si
from ..operators import raster
from .base import Tables, query

OPERATORS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
}


def condition(filters: list[dict], combine: str = "all") -> Column:
    """A condition of {column, operator, type, value} entries: all, any or none of them. Values are literals of their type, never SQL text."""
    typed = lambda f, v: F.lit(v).cast(f["type"]) if f.get("type") else F.lit(v)
    each = [OPERATORS[f["operator"]](F.col(f["column"]), [typed(f, v) for v in f["value"]] if isinstance(f["value"], (list, tuple)) else typed(f, f["value"])) for f in filters]
    if combine == "any":
        return reduce(lambda a, b: a | b, each, F.lit(False)) if each else F.lit(True)
    return reduce(lambda a, b: a & b, each if combine == "all" else [~e for e in each], F.lit(True))


@query("""SELECT 'all' AS mode, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000
UNION ALL SELECT 'any', o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') OR o_totalprice >= 100000
UNION ALL SELECT 'none', o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O')) AND NOT (o_totalprice >= 100000)""")
def filter_spec(t: Tables) -> DataFrame:
    spec = [{"column": "o_orderstatus", "operator": "in", "value": ["F", "O"]}, {"column": "o_totalprice", "operator": ">=", "type": "double", "value": "100000"}]
    return reduce(DataFrame.union, [t.orders.where(condition(spec, m)).select(F.lit(m).alias("mode"), "o_orderkey") for m in ("all", "any", "none")])


@query("SELECT scene_id, r, c, b4 AS b1, b2, b1 AS b3 FROM px4")
def band_select_reorder(t: Tables) -> DataFrame:
    return t.px4.select("scene_id", "r", "c", F.col("b4").alias("b1"), "b2", F.col("b1").alias("b3"))


_TWELVE = {"blue": "b2", "green": "b3", "red": "b4", "edge": "b5", "nir": "b8", "swir": "b7", "vv": "b1", "vh": "b2"}


@query("""SELECT scene_id, r, c,
  round((b8 - b4) / nullif(CAST(b8 + b4 AS DOUBLE), 0), 6) + 0.0 AS ndvi, round(1.5 * (b8 - b4) / (b8 + b4 + 0.5), 6) + 0.0 AS savi,
  round(CASE WHEN b4 <> 0 THEN b8 / CAST(b4 AS DOUBLE) - 1 ELSE 0.0 END, 6) + 0.0 AS reci, round(CASE WHEN b3 <> 0 THEN b8 / CAST(b3 AS DOUBLE) - 1 ELSE 0.0 END, 6) + 0.0 AS gci,
  round(CAST(2.5 AS DOUBLE) * (b8 - b4) / (b8 + CAST(2.4 AS DOUBLE) * b4 + 1), 6) + 0.0 AS evi2, round(CASE WHEN b8 - b4 <> 0 THEN (b8 - b2) / CAST(b8 - b4 AS DOUBLE) ELSE 0.0 END, 6) + 0.0 AS sipi,
  round((b8 - b5) / nullif(CAST(b8 + b5 AS DOUBLE), 0), 6) + 0.0 AS ndre, round((b8 - b7) / nullif(CAST(b8 + b7 AS DOUBLE), 0), 6) + 0.0 AS ndmi,
  round(2 * (b2 - b1) / nullif(CAST(b2 + b1 AS DOUBLE), 0), 6) + 0.0 AS ndrvi, round(CASE WHEN b1 <> 0 THEN b2 / CAST(b1 AS DOUBLE) ELSE 0.0 END, 6) + 0.0 AS ri,
  round(4 * b2 / nullif(CAST(b2 + b1 AS DOUBLE), 0), 6) + 0.0 AS rvi, round(sqrt(b1 / nullif(CAST(b1 + b2 AS DOUBLE), 0)) * 4 * b2 / nullif(CAST(b2 + b1 AS DOUBLE), 0), 6) + 0.0 AS rvi4s1
FROM px8""")
def spectral_index(t: Tables) -> DataFrame:
    bands = {k: F.col(v) for k, v in _TWELVE.items()}
    names = ["NDVI", "SAVI", "RECI", "GCI", "EVI2", "SIPI", "NDRE", "NDMI", "NDRVI", "RI", "RVI", "RVI4S1"]
    return t.px8.select("scene_id", "r", "c", *[F.round(index(n, bands), 6).alias(n.lower()) for n in names])


@query("""SELECT scene_id, r, c,
  round((b8 - b6) / nullif(CAST(b8 + b6 AS DOUBLE), 0), 6) + 0.0 AS ndvi, round(1.5 * (b8 - b6) / (b8 + b6 + 0.5), 6) + 0.0 AS savi,
  round(CASE WHEN b6 <> 0 THEN b8 / CAST(b6 AS DOUBLE) - 1 ELSE 0.0 END, 6) + 0.0 AS reci, round(CASE WHEN b4 <> 0 THEN b8 / CAST(b4 AS DOUBLE) - 1 ELSE 0.0 END, 6) + 0.0 AS gci,
  round(CAST(2.5 AS DOUBLE) * (b8 - b6) / (b8 + CAST(2.4 AS DOUBLE) * b6 + 1), 6) + 0.0 AS evi2, round(CASE WHEN b8 - b6 <> 0 THEN (b8 - b2) / CAST(b8 - b6 AS DOUBLE) ELSE 0.0 END, 6) + 0.0 AS sipi,
  round((b8 - b7) / nullif(CAST(b8 + b7 AS DOUBLE), 0), 6) + 0.0 AS ndre
FROM px8""")
def spectral_index_8band(t: Tables) -> DataFrame:
    bands = {k: F.col(v) for k, v in EIGHT_BANDS.items()}
    return t.px8.select("scene_id", "r", "c", *[F.round(index(n, bands), 6).alias(n.lower()) for n in EIGHT_BAND_INDICES])


@query("""SELECT scene_id, r, c, round((b4 - b3) / nullif(CAST(b4 + b3 AS DOUBLE), 0), 6) + 0.0 AS own, round(sqrt(abs(CAST(b4 - b1 AS DOUBLE))) / (b2 + 1), 6) + 0.0 AS other FROM px4""")
def index_expressions(t: Tables) -> DataFrame:
    bands = {"blue": F.col("b1"), "green": F.col("b2"), "red": F.col("b3"), "nir": F.col("b4")}
    formulas = {"own": "(nir - red) / (nir + red)", "other": "sqrt(abs(nir - blue)) / (green + 1)"}
    return t.px4.select("scene_id", "r", "c", *[F.round(expression(f, bands), 6).alias(n) for n, f in formulas.items()])


@query("""WITH i AS (SELECT scene_id, r, c, cbrt(b4 + 1) * cbrt(65536 - b3) * (CASE WHEN b4 < b3 THEN CAST('NaN' AS DOUBLE) ELSE cbrt(CAST(b4 - b3 AS DOUBLE)) END) AS avi,
  cbrt(65536 - b1) * cbrt(65536 - b2) * cbrt(65536 - b3) AS si, CAST(2.5 AS DOUBLE) * (b4 - b3) / nullif(1 + b4 + 6 * b3 - CAST(7.5 AS DOUBLE) * b1, 0) AS evi FROM px4)
SELECT scene_id, r, c, CASE WHEN isnan(avi) THEN NULL ELSE round(avi, 3) + 0.0 END AS avi, round(si, 2) AS si, round(evi, 6) + 0.0 AS evi,
  CASE WHEN isnan(avi) THEN NULL ELSE round(avi * 100.0 / max(CASE WHEN NOT isnan(avi) THEN avi END) OVER (PARTITION BY scene_id), 4) + 0.0 END AS avi_scaled,
  round(si * 100.0 / max(si) OVER (PARTITION BY scene_id), 4) AS ssi FROM i""")
def vegetation_indices(t: Tables) -> DataFrame:
    b = {"blue": F.col("b1"), "green": F.col("b2"), "red": F.col("b3"), "nir": F.col("b4")}
    made = t.px4.select("scene_id", "r", "c", F.nanvl(avi(b), F.lit(None).cast("double")).alias("avi"), si({"blue": F.col("b1"), "green": F.col("b2"), "red": F.col("b3")}).alias("si"), evi(b).alias("evi"))
    # The greatest of a scene comes back by a join, so that one scene is never one task.
    top = made.groupBy("scene_id").agg(F.max("avi").alias("_a"), F.max("si").alias("_s"))
    return made.join(top, "scene_id").select("scene_id", "r", "c", F.round("avi", 3).alias("avi"), F.round("si", 2).alias("si"), F.round("evi", 6).alias("evi"), F.round(F.col("avi") * 100.0 / F.col("_a"), 4).alias("avi_scaled"), F.round(F.col("si") * 100.0 / F.col("_s"), 4).alias("ssi"))


@query("SELECT r, c, CASE cls WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE cls END AS cls FROM cls_before")
def remap_class(t: Tables) -> DataFrame:
    return t.cls_before.select("r", "c", raster.code(F.col("cls"), {1: 3, 2: 1, 3: 2}).alias("cls"))


@query("SELECT scene_id, r, c, CASE WHEN b1 / 50.0 >= 0.4 THEN 255 ELSE 0 END AS forest, CASE WHEN b2 <> 0 THEN 1 ELSE 0 END AS present FROM px")
def binarize(t: Tables) -> DataFrame:
    return t.px.select("scene_id", "r", "c", raster.binarize(F.col("b1") / 50.0, 0.4).alias("forest"), F.when(F.col("b2") != 0, 1).otherwise(0).alias("present"))


@query("SELECT r, c, CASE WHEN cls = 1 THEN 255 ELSE 0 END AS on_band, CASE WHEN cls = 1 THEN 0 ELSE 255 END AS off_band FROM cls_before")
def mask_one_hot(t: Tables) -> DataFrame:
    m = (F.col("cls") == 1).cast("int")
    return t.cls_before.select("r", "c", (255 * m).alias("on_band"), (255 * (1 - m)).alias("off_band"))


@query("""WITH m AS (SELECT r, c, CASE WHEN cls = 1 THEN 255 ELSE 0 END AS v FROM cls_before),
o AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc)),
e AS (SELECT m.r, m.c, m.v, max(CASE WHEN n.v <> m.v THEN 1 ELSE 0 END) AS edge FROM m JOIN m n ON abs(n.r - m.r) + abs(n.c - m.c) <= 1 GROUP BY 1, 2, 3),
l AS (SELECT r, c, CASE WHEN v = 255 AND edge = 1 THEN 1 ELSE 0 END AS line, v FROM e),
d AS (SELECT l.r + dr AS r, l.c + dc AS c, max(line) AS line FROM l CROSS JOIN o GROUP BY 1, 2)
SELECT l.r, l.c, CASE WHEN d.line = 1 THEN 1 WHEN l.v = 255 THEN 2 ELSE 0 END AS cls FROM l JOIN d ON d.r = l.r AND d.c = l.c""")
def mask_with_boundary(t: Tables) -> DataFrame:
    m = t.cls_before.select("r", "c", F.when(F.col("cls") == 1, 255).otherwise(0).alias("cls"))
    around = raster.gradient(m, raster.kernel(3, "cross")).withColumnRenamed("cls", "edge")
    line = m.join(around, ["r", "c"]).select("r", "c", ((F.col("cls") == 255) & (F.col("edge") > 0)).cast("int").alias("cls"))
    wide = raster.dilate(line, raster.kernel(3)).withColumnRenamed("cls", "line")
    return m.join(wide, ["r", "c"]).select("r", "c", F.when(F.col("line") == 1, 1).when(F.col("cls") == 255, 2).otherwise(0).alias("cls"))


@query("SELECT scene_id, p.r, p.c, CASE WHEN k.cls = 3 THEN 0 ELSE b1 END AS b1, CASE WHEN k.cls = 3 THEN 0 ELSE b2 END AS b2 FROM px p LEFT JOIN cls_before k ON k.r = p.r AND k.c = p.c")
def mask_to_nodata(t: Tables) -> DataFrame:
    cloud = F.coalesce(F.col("cls") == 3, F.lit(False))
    return t.px.join(t.cls_before, ["r", "c"], "left").select("scene_id", "r", "c", *[F.when(cloud, 0).otherwise(F.col(b)).alias(b) for b in ("b1", "b2")])


@query("""WITH p AS (SELECT scene_id, quantile_cont(b1, 0.02) AS low FROM px WHERE b1 <> 0 GROUP BY 1)
SELECT px.scene_id, r, c, round(CASE WHEN b1 = 0 THEN 0.0 ELSE greatest(b1 - low + 10, 1) END, 6) AS b1 FROM px JOIN p ON p.scene_id = px.scene_id""")
def shift_distribution(t: Tables) -> DataFrame:
    low = raster.limits(t.px, ["b1"]).select("scene_id", "p_low")
    return t.px.join(low, "scene_id").select("scene_id", "r", "c", F.round(F.when(F.col("b1") == 0, 0.0).otherwise(F.greatest(F.col("b1") - F.col("p_low") + 10, F.lit(1.0))), 6).alias("b1"))


@query("""WITH m AS (SELECT min(b1) AS lo, max(b1) AS hi FROM px)
SELECT scene_id, r, c, round(coalesce((b1 - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 0.0), 6) AS b1, CAST(floor(coalesce((b1 - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 0.0) * 255) AS INT) AS b1_byte FROM px CROSS JOIN m""")
def rescale_minmax(t: Tables) -> DataFrame:
    m = t.px.agg(F.min("b1").alias("lo"), F.max("b1").alias("hi"))  # one row
    unit = raster.linear(F.col("b1"), F.col("lo"), F.col("hi"), 0.0, 1.0)
    return t.px.join(F.broadcast(m)).select("scene_id", "r", "c", F.round(unit, 6).alias("b1"), F.floor(unit * 255).cast("int").alias("b1_byte"))


_LIMITS = """l AS (SELECT scene_id, quantile_cont(b1, 0.02) AS lo, quantile_cont(b1, 0.98) AS hi FROM px WHERE b1 <> 0 GROUP BY 1)"""


@query(f"""WITH {_LIMITS} SELECT px.scene_id, r, c, CAST(CASE WHEN b1 = 0 THEN 0 ELSE floor(1 + least(greatest((b1 - lo) / nullif(hi - lo, 0), 0.0), 1.0) * 254) END AS INT) AS b1 FROM px JOIN l ON l.scene_id = px.scene_id""")
def stretch_p2_p98(t: Tables) -> DataFrame:
    l = raster.limits(t.px, ["b1"]).select("scene_id", "p_low", "p_high")
    return t.px.join(l, "scene_id").select("scene_id", "r", "c", F.when(F.col("b1") == 0, 0).otherwise(F.floor(raster.linear(F.col("b1"), F.col("p_low"), F.col("p_high"), 1.0, 255.0))).cast("int").alias("b1"))


@query(f"""WITH {_LIMITS}, ref AS (SELECT lo AS rlo, hi AS rhi FROM l WHERE scene_id = 'A')
SELECT px.scene_id, r, c, round(rlo + least(greatest((b1 - lo) / nullif(hi - lo, 0), 0.0), 1.0) * (rhi - rlo), 6) AS b1 FROM px JOIN l ON l.scene_id = px.scene_id CROSS JOIN ref WHERE b1 <> 0""")
def match_percentiles(t: Tables) -> DataFrame:
    l = raster.limits(t.px, ["b1"]).select("scene_id", "p_low", "p_high")
    ref = l.where("scene_id = 'A'").select(F.col("p_low").alias("rlo"), F.col("p_high").alias("rhi"))  # one row
    unit = raster.linear(F.col("b1"), F.col("p_low"), F.col("p_high"), 0.0, 1.0)
    return t.px.where("b1 <> 0").join(l, "scene_id").join(F.broadcast(ref)).select("scene_id", "r", "c", F.round(F.col("rlo") + unit * (F.col("rhi") - F.col("rlo")), 6).alias("b1"))


@query("SELECT scene_id, r, c, 105.5 + c * 0.5 AS x, 21.25 - r * 0.5 AS y FROM px")
def affine_pixel_to_geo(t: Tables) -> DataFrame:
    return t.px.select("scene_id", "r", "c", (F.lit(105.5) + F.col("c") * F.lit(0.5)).alias("x"), (F.lit(21.25) - F.col("r") * F.lit(0.5)).alias("y"))


@query("SELECT id, CAST(trunc((x - 10.0) / 2.0) AS INT) AS c, CAST(trunc((500.0 - y) / 2.0) AS INT) AS r FROM points")
def affine_geo_to_pixel(t: Tables) -> DataFrame:
    return t.points.select("id", ((F.col("x") - 10.0) / 2.0).cast("int").alias("c"), ((500.0 - F.col("y")) / 2.0).cast("int").alias("r"))


@query("""SELECT scene_id, r // 10 AS tr, c // 10 AS tc, round(avg(CASE WHEN b1 > 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM px
GROUP BY 1, 2, 3 HAVING avg(CASE WHEN b1 > 25 THEN 1.0 ELSE 0.0 END) >= 0.5""")
def label_fraction_filter(t: Tables) -> DataFrame:
    share = F.avg((F.col("b1") > 25).cast("double"))
    return t.px.groupBy("scene_id", F.floor(F.col("r") / 10).cast("int").alias("tr"), F.floor(F.col("c") / 10).cast("int").alias("tc")).agg(share.alias("s")).where("s >= 0.5").select("scene_id", "tr", "tc", F.round("s", 6).alias("share"))


@query("""SELECT scene_id, r // 10 AS tr, c // 10 AS tc, count(*) AS cells FROM px GROUP BY 1, 2, 3 HAVING avg(CASE WHEN b1 < 20 THEN 1.0 ELSE 0.0 END) < 0.3""")
def nodata_tile_filter(t: Tables) -> DataFrame:
    tiles = t.px.groupBy("scene_id", F.floor(F.col("r") / 10).cast("int").alias("tr"), F.floor(F.col("c") / 10).cast("int").alias("tc"))
    return tiles.agg(F.count("*").alias("cells"), F.avg((F.col("b1") < 20).cast("double")).alias("s")).where("s < 0.3").drop("s")


@query("SELECT scene, acquired, cloud FROM scenes WHERE acquired >= TIMESTAMP '1995-01-01' AND acquired <= TIMESTAMP '1996-06-30' AND cloud <= 20")
def catalog_filter(t: Tables) -> DataFrame:
    return t.scenes.where(F.col("acquired").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz")) & (F.col("cloud") <= 20))


@query("SELECT 'S2_' || scene AS id, CAST(acquired AS DATE) AS acquired, cloud / 100.0 AS cloud_cover, split_part('S2_' || scene || '.SAFE', '.', 1) || '.png' AS thumbnail FROM scenes")
def catalog_project(t: Tables) -> DataFrame:
    name = F.concat(F.lit("S2_"), F.col("scene").cast("string"))
    return t.scenes.select(name.alias("id"), F.col("acquired").cast("date").alias("acquired"), (F.col("cloud") / 100.0).alias("cloud_cover"), F.concat(F.split(F.concat(name, F.lit(".SAFE")), r"\.")[0], F.lit(".png")).alias("thumbnail"))


@query("""WITH n AS (SELECT scene, 'S1A_IW_GRDH_' || CASE WHEN scene % 3 = 0 THEN '1SDV' ELSE '1SSV' END || '_' || strftime(acquired, '%Y%m%d') || 'T101112_X' AS title FROM scenes)
SELECT scene, title, CAST(strptime(substr(split_part(title, '_', 5), 1, 8), '%Y%m%d') AS DATE) AS day FROM n WHERE contains(title, '_1SDV')""")
def catalog_parse_title(t: Tables) -> DataFrame:
    title = F.concat(F.lit("S1A_IW_GRDH_"), F.when(F.col("scene") % 3 == 0, "1SDV").otherwise("1SSV"), F.lit("_"), F.date_format("acquired", "yyyyMMdd"), F.lit("T101112_X"))
    named = t.scenes.select("scene", title.alias("title")).where(F.col("title").contains("_1SDV"))
    return named.select("scene", "title", F.to_date(F.substring(F.element_at(F.split("title", "_"), 5), 1, 8), "yyyyMMdd").alias("day"))


@query("""SELECT event_id, round(ln(greatest(coalesce(value, 0), 0) + 1), 6) AS i1, CAST('0x' || substr(md5(event_type), 1, 8) AS BIGINT) % 1000 AS c1 FROM events""")
def click_log_clean(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(F.log1p(F.greatest(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))), 6).alias("i1"), (F.conv(F.substring(F.md5("event_type"), 1, 8), 16, 10).cast("long") % 1000).alias("c1"))


GENRES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ANODIZED", "BRUSHED", "BURNISHED", "PLATED", "POLISHED"]


@query(f"""SELECT p_partkey, array_to_string(list_transform({GENRES!r}, lambda g: CASE WHEN list_contains(string_split(upper(p_type), ' '), g) THEN 1 ELSE 0 END), ',') AS hot FROM part""".replace('"', "'"))
def multi_hot(t: Tables) -> DataFrame:
    words = F.split(F.upper("p_type"), " ")
    return t.part.select("p_partkey", F.concat_ws(",", *[F.array_contains(words, g).cast("int").cast("string") for g in GENRES]).alias("hot"))


@query("SELECT id, x, y, 3857 AS srid FROM points")
def crs_assign(t: Tables) -> DataFrame:
    return t.points.withColumn("srid", F.lit(4326)).withColumn("srid", F.lit(3857))


@query("""WITH g AS (SELECT id, x / 10.0 AS lon, y / 20.0 AS lat FROM points),
m AS (SELECT id, lon, lat, 6378137.0 * radians(lon) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM g)
SELECT id, round(mx, 3) AS mx, round(my, 3) + 0.0 AS my, round(degrees(mx / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 6) + 0.0 AS lat FROM m""")
def reproject_4326_3857(t: Tables) -> DataFrame:
    from ..functions.geometry import from_mercator, to_mercator

    g = t.points.select("id", (F.col("x") / 10.0).alias("lon"), (F.col("y") / 20.0).alias("lat"))
    mx, my = to_mercator(F.col("lon"), F.col("lat"))
    back = g.select("id", mx.alias("mx"), my.alias("my"))
    lon, lat = from_mercator(F.col("mx"), F.col("my"))
    return back.select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))
