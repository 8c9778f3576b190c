"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in every operator here: space, and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Folders of local sessions without spark.checkpoint.dir.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets one of its own (tests); a cluster is refused, since its executors would each write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="geoloom-"))
    return path.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to and from Python hold most bytes at most, so that long texts in a batch don't add up in a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/geoloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """rid and sid tell rows of another doc_id or text apart (a hash of both, and doc_id itself); rows that repeat both share them."""
    own = F.col(doc_id).cast("long")
    return [F.xxhash64(own, text).alias("rid"), F.coalesce(own, F.lit(0)).alias("sid")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def least_hashed(rows: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """The most rows of each group with the least hash of key (then the least key): a sample that every run draws alike.

    Counts first give a hash below which about four times as many lie, so that the window that ranks them gets rows by the
    sample's size, not by the group's.
    """
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    counts = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_all"))
    near = rows.join(counts, F.col(group) == F.col("_group")).withColumn("_draw", draw).where(F.col("_draw") * F.col("_all") <= 4 * most)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_draw", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_group", "_all", "_draw", "_rank")
