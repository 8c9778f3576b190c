"""Layers, annotations and tables as files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, name (properties), geom_type, x, y of point features of all GeoJSON files below path."""
    layers = spark.read.schema(GEOJSON).option("multiLine", "true").json(path)
    f = layers.select(F.explode("features").alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    return f.select(F.col("f.properties")["id"].cast("long").alias("id"), F.col("f.properties")["name"].alias("name"), F.col("f.geometry.type").alias("geom_type"), at[0].alias("x"), at[1].alias("y"))


def _documents(features: DataFrame, head: str, glue: str, tail: str, most: int) -> DataFrame:
    """Rows of text: features (one string column) gathered where they are, most to a document."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def document() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head + glue.join(held) + tail], pa.string())], names=["value"])

        for batch in batches:
            for feature in batch.column(0).to_pylist():
                held.append(feature)
                if len(held) == most:
                    yield document()
                    held.clear()
        if held:
            yield document()

    return features.mapInArrow(gathered, "value string")


def write_geojson_points(points: DataFrame, path: str, most: int = 10000) -> None:
    """FeatureCollections of most features each, a file each; points: id, name, x, y."""
    feature = F.format_string('{"type":"Feature","properties":{"id":"%s","name":%s},"geometry":{"type":"Point","coordinates":[%s,%s]}}', F.col("id").cast("string"), F.to_json(F.struct("name")).substr(F.lit(9), F.length(F.to_json(F.struct("name"))) - 9), F.col("x").cast("string"), F.col("y").cast("string"))
    _documents(points.select(feature.alias("value")), '{"type":"FeatureCollection","features":[', ",", "]}", most).write.option("maxRecordsPerFile", 1).text(path)


def write_xml(features: DataFrame, root: str, path: str, most: int = 10000) -> None:
    """Documents of most features each, a file each; features: id, xml."""
    _documents(features.select("xml"), f"<{root}>", "", f"</{root}>", most).write.option("maxRecordsPerFile", 1).text(path)


def read_placemarks(spark: SparkSession, path: str, row_tag: str, coordinates: str, point_tag: str = "Point") -> DataFrame:
    """id, x, y of XML features: row_tag holds name and point_tag, whose coordinates are "x,y" or "x y"."""
    schema = f"name string, {point_tag} struct<{coordinates}: string>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    xy = F.split(F.trim(F.col(f"{point_tag}.{coordinates}")), "[, ]+")
    return rows.select(F.col("name").cast("long").alias("id"), xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))


def validated(layer: DataFrame, valid: Column, geom_type: str, bounds: Sequence[str]) -> DataFrame:
    """The valid rows of layer; fails if none is left, a bound is infinite (beyond 1e100) or types mix (a type and its Multi are one)."""
    kept = layer.where(valid)
    s = kept.agg(F.count("*").alias("n"), F.collect_set(F.regexp_replace(geom_type, "^Multi", "")).alias("kinds"), F.max(F.array_max(F.array(*[F.abs(F.col(b).cast("double")) for b in bounds]))).alias("far")).first()
    if not s["n"]:
        raise ValueError("the layer has no valid geometry")
    if s["far"] is None or s["far"] >= 1e100:
        raise ValueError("the layer has infinite bounds")
    if len(s["kinds"]) > 1:
        raise ValueError(f"the layer mixes {sorted(s['kinds'])}")
    return kept


def reconciled(layer: DataFrame, columns: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """layer with the columns of its target: unknown ones go, missing ones are null, a single geometry becomes a list of one."""
    have = set(layer.columns)
    out = [F.col(c) if c in have else F.lit(None).alias(c) for c in columns]
    return layer.select(*[F.array(F.col(c)).alias(c) if c == geometry else o for c, o in zip(columns, out, strict=True)])


def decode_runs(masks: DataFrame, key: str, runs: str, height: int) -> DataFrame:
    """key, r, c of each cell of "start length start length ..." masks (from 1, down the columns)."""
    n = F.transform(F.split(F.trim(F.col(runs)), r"\s+"), lambda x: x.cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, 2 * i).alias("s"), F.get(n, 2 * i + 1).alias("l")))
    cells = masks.select(key, F.explode(pairs).alias("p")).select(key, F.explode(F.sequence(F.col("p.s") - 1, F.col("p.s") + F.col("p.l") - 2)).alias("i"))
    return cells.select(key, (F.col("i") % height).alias("r"), F.floor(F.col("i") / height).cast("int").alias("c"))
