"""The tables of a folder, views derived from them, and the register of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views in SQL that Spark and DuckDB read alike; imagery, layers, boxes and ratings stand on the driver's tables.
VIEWS = {
    "px": """SELECT l_returnflag AS scene_id, CAST(l_orderkey % 100 AS INT) AS r, CAST(l_partkey % 100 AS INT) AS c,
        MAX(CAST(l_quantity AS INT)) AS b1, MIN(CAST(l_quantity AS INT)) AS b2 FROM lineitem GROUP BY 1, 2, 3""",
    "px4": """SELECT scene_id, r, c, b1, b2, CAST((r * 7 + b1 * 3) % 101 AS INT) AS b3, CAST((c * 5 + b2 * 11) % 103 AS INT) AS b4 FROM px""",
    "px8": """SELECT scene_id, r, c, b1, b2, b3, b4, CAST((b1 + b3) % 97 AS INT) AS b5, CAST((b2 + b4) % 89 AS INT) AS b6,
        CAST((b3 + 2 * b1) % 83 AS INT) AS b7, CAST((b4 + 3 * b2) % 79 AS INT) AS b8 FROM px4""",
    "cls_before": """SELECT CAST(o_orderkey % 100 AS INT) AS r, CAST(o_custkey % 100 AS INT) AS c,
        MAX(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS cls FROM orders GROUP BY 1, 2""",
    "cls_after": """SELECT CAST(o_orderkey % 100 AS INT) AS r, CAST(o_custkey % 100 AS INT) AS c,
        CAST(1 + MAX(o_orderkey) % 3 AS INT) AS cls FROM orders GROUP BY 1, 2""",
    "zones": """SELECT n_name AS zone, CAST((n_nationkey % 5) * 20 AS INT) AS xmin, CAST((n_nationkey - n_nationkey % 5) * 4 AS INT) AS ymin,
        CAST((n_nationkey % 5) * 20 + 20 AS INT) AS xmax, CAST((n_nationkey - n_nationkey % 5) * 4 + 20 AS INT) AS ymax FROM nation""",
    "boxes": """SELECT p_partkey AS id, p_partkey % 10 AS img, CAST((p_partkey * 37) % 307 AS INT) AS xmin, CAST((p_partkey * 91) % 211 AS INT) AS ymin,
        CAST((p_partkey * 37) % 307 + p_size AS INT) AS xmax, CAST((p_partkey * 91) % 211 + p_size AS INT) AS ymax, p_retailprice AS score FROM part""",
    "truths": """SELECT s_suppkey AS id, s_suppkey % 10 AS img, CAST((s_suppkey * 37) % 307 AS INT) AS xmin, CAST((s_suppkey * 91) % 211 AS INT) AS ymin,
        CAST((s_suppkey * 37) % 307 + 10 + s_suppkey % 20 AS INT) AS xmax, CAST((s_suppkey * 91) % 211 + 10 + s_suppkey % 15 AS INT) AS ymax FROM supplier""",
    "points": "SELECT c_custkey AS id, CAST((c_custkey * 7919) % 1000 AS INT) AS x, CAST((c_custkey * 104729) % 1000 AS INT) AS y FROM customer",
    "scenes": "SELECT o_orderkey AS scene, o_orderdate AS acquired, CAST(o_orderkey % 101 AS INT) AS cloud FROM orders",
    "ratings": "SELECT o_custkey AS user_id, l_partkey AS item_id, l_linenumber AS rating, o_orderdate AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "preds": "SELECT l_orderkey AS q, l_partkey AS cls, l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS correct, l_linenumber AS n FROM lineitem",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables and views as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name]
            used = [n for n in (*NAMES, *VIEWS) if n != name and re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)]
            return self.spark.sql(re.sub(r"((?:FROM|JOIN)\s+)(\w+)", lambda m: f"{m[1]}{{{m[2]}}}" if m[2] in used else m[0], sql), **{n: getattr(self, n) for n in used})
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """sql after the definitions of the views that it uses."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    if not views:
        return sql
    body = sql.strip()
    return f"WITH {views}, {body[5:]}" if re.match(r"WITH\s(?!RECURSIVE)", body) else f"WITH RECURSIVE {views}, {body[15:]}" if body.startswith("WITH RECURSIVE") else f"WITH {views} {body}"


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL that gives its rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register
