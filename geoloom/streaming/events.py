"""Structured Streaming over event tables, each run to the end of what is there (availableNow)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..scratch import scratch


def run_to_end(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """The rows that a streaming query gives, read back from a Parquet sink in the shared folder.

    append: the sink's rows. update: each micro-batch appends its changed rows with its number; the last of a key wins
    where the caller asks for it.
    """
    spark = stream.sparkSession
    path, state = scratch(spark, label), scratch(spark, f"{label}-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        keep = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields]).add("_batch", "long")
    return spark.read.schema(schema).parquet(path)


def table_stream(spark: SparkSession, df: DataFrame, label: str, slices: int = 4, end: DataFrame | None = None) -> DataFrame:
    """df as a stream: slices of time written one after the other, and read a micro-batch each in that order. end: rows that come last.

    The range deal is written once and its slices are copied from there. A slice has as many files as the deal gave it
    parts; one micro-batch takes as many files as the smallest slice has, so state is carried and files arrive by time.
    """
    path, dealt = scratch(spark, label), scratch(spark, f"{label}-dealt")
    number = max(slices, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(number, "ts").withColumn("_part", F.spark_partition_id()).write.parquet(dealt)
    table = spark.read.schema(df.withColumn("_part", F.lit(0)).schema).parquet(dealt)
    parts = [r["_part"] for r in table.select("_part").distinct().orderBy("_part").collect()]  # one for each part
    slices = max(1, min(slices, len(parts)))
    edges = [len(parts) * i // slices for i in range(slices + 1)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = table.where(F.col("_part").isin(parts[a:b])).repartition(max(1, b - a), "_part").drop("_part")
        own.write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    if end is not None:
        end.write.mode("append").parquet(path)
    each = max(1, min((b - a for a, b in zip(edges[:-1], edges[1:], strict=True)), default=1))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    values = [c for c in updates.columns if c not in keys and c != "_batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with several states need, for the queries started within; the session's own setting comes back after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


#: A waiting row: microseconds, event, number of arrival, user and clear value (NaN: none).
_ROW = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("number", "<i8"), ("user_id", "<i8"), ("clear", "<f8")])
_ORDER = ("us", "event_id", "number")


def _in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort([rows[c] for c in reversed(_ORDER)])]


def _after(rows: np.ndarray, done: tuple[int, int, int] | None) -> np.ndarray:
    """The rows that come later than done in the order of _ORDER."""
    if done is None:
        return rows
    us, event, number = (rows[c] for c in _ORDER)
    return rows[(us > done[0]) | ((us == done[0]) & ((event > done[1]) | ((event == done[1]) & (number > done[2]))))]


def _fill(rows: np.ndarray, known: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows (in order) by user, with their filled values, and the users (in order) with a clear value so far and their last one. known, last: those before."""
    rows = rows[np.argsort(rows["user_id"], kind="stable")]
    user, at = rows["user_id"], np.arange(len(rows))
    starts = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
    first = np.repeat(starts, np.diff(np.append(starts, len(rows))))
    clear = np.maximum.accumulate(np.where(np.isnan(rows["clear"]), -1, at))
    filled = np.where(clear >= first, rows["clear"][clear], np.nan)
    if len(known):
        place = np.minimum(np.searchsorted(known, user), len(known) - 1)
        filled = np.where((clear < first) & (known[place] == user), last[place], filled)
    ends = np.append(starts[1:], len(rows)) - 1
    ends = ends[~np.isnan(filled[ends])]
    rest = ~np.isin(known, user[ends])
    users, values = np.concatenate([known[rest], user[ends]]), np.concatenate([last[rest], filled[ends]])
    order = np.argsort(users)
    return rows, filled, users[order], values[order]


class LastClear(StatefulProcessor):
    """Each row's value, or the user's last one that was clear where its own is null, in the order of (ts, event_id) however the rows arrive.

    A key is a bucket of users, so that the calls to the state are shared by many of them. Rows wait in blocks of CHUNK at
    most until the watermark has passed them, when no earlier one can come; a timer at the first one waiting lets them go,
    CHUNK at a time, and those still waiting are put together to new blocks. Besides the blocks a key's state is
    the last clear value of each of its users, the numbers of its blocks and the timer. So late rows within the
    watermark's delay get the answer of a batch, and no task holds more than a few times CHUNK rows, also of one frequent user;
    rows later than that are dropped by Spark.
    """

    CHUNK = 100_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "rows binary")
        self.state = handle.getValueState("state", "users binary, last binary, first long, end long, waiting long, number long, timer long")

    def _wait(self, timer: int | None, us: int) -> int:
        """The key's timer, not later than just after us (microseconds)."""
        wanted = us // 1000 + 1
        if timer is not None and timer <= wanted:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)
        return wanted

    def _block(self, number: int) -> np.ndarray:
        return np.frombuffer(bytes(self.blocks.getValue((number,))[0]), _ROW)

    def _put(self, number: int, rows: np.ndarray) -> None:
        self.blocks.updateValue((number,), (rows.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        users, last, first, end, waiting, number, timer = self.state.get() if self.state.exists() else (b"", b"", 0, 0, 0, 0, None)
        for frame in rows:
            for begin in range(0, len(frame), self.CHUNK):
                part = frame.iloc[begin : begin + self.CHUNK]
                block = np.empty(len(part), _ROW)
                for c in ("us", "event_id", "user_id", "clear"):
                    block[c] = part[c].to_numpy(_ROW[c], na_value=np.nan) if c == "clear" else part[c].to_numpy()
                block["number"] = np.arange(number, number + len(part))
                self._put(end, block)
                end, waiting, number = end + 1, waiting + len(part), number + len(part)
                timer = self._wait(timer, int(block["us"].min()))
        self.state.update((bytes(users), bytes(last), first, end, waiting, number, timer))
        return iter(())

    def _earliest(self, blocks: Iterable[np.ndarray], done: tuple[int, int, int] | None, passed: int) -> np.ndarray:
        """The first CHUNK of the rows later than done that the watermark has passed, in order."""
        held, size = [np.empty(0, _ROW)], 0
        for rows in blocks:
            held.append(_after(rows[rows["us"] <= passed], done))
            size += len(held[-1])
            if size > 2 * self.CHUNK:
                held = [_in_order(np.concatenate(held))[: self.CHUNK]]
                size = self.CHUNK
        return _in_order(np.concatenate(held))[: self.CHUNK]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        users, last, first, end, waiting, number, _ = self.state.get()
        known, last = np.frombuffer(bytes(users), "<i8"), np.frombuffer(bytes(last), "<f8")
        passed, done, old = timerValues.getCurrentWatermarkInMs() * 1000, None, range(first, end)
        # Few rows are read once; of more, a block at a time is held, and read again for each chunk.
        all_of_them = [self._block(i) for i in old] if waiting <= self.CHUNK else None
        blocks = lambda: all_of_them or (self._block(i) for i in old)
        more = True
        while more and len(chunk := self._earliest(blocks(), done, passed)):
            done, more = tuple(int(chunk[c][-1]) for c in _ORDER), len(chunk) == self.CHUNK
            rows, filled, known, last = _fill(chunk, known, last)
            yield pd.DataFrame({"key": key[0], "user_id": rows["user_id"], "event_id": rows["event_id"], "filled": filled})
        timer, kept, waiting = None, [], 0
        for rows in blocks():
            kept.append(rows[rows["us"] > passed])
            if sum(map(len, kept)) >= self.CHUNK:
                waiting, end, timer = self._keep(kept, waiting, end, timer)
                kept = []
        waiting, end, timer = self._keep(kept, waiting, end, timer)
        for i in old:
            self.blocks.removeKey((i,))
        self.state.update((known.tobytes(), last.tobytes(), old.stop, end, waiting, number, timer))

    def _keep(self, kept: list[np.ndarray], waiting: int, end: int, timer: int | None) -> tuple[int, int, int | None]:
        """Puts the rows that still wait into new blocks, from number end on."""
        rows = np.concatenate([np.empty(0, _ROW), *kept])
        for i in range(0, len(rows), self.CHUNK):
            self._put(end, rows[i : i + self.CHUNK])
            end += 1
        if len(rows):
            timer = self._wait(timer, int(rows["us"].min()))
        return waiting + len(rows), end, timer

    def close(self) -> None:
        pass


#: Stands for a missing event_id, the first of its time.
_NO_EVENT = -(1 << 63)
#: Users go to so many buckets.
_BUCKETS = 1024


def filled(stream: DataFrame, delay: str) -> DataFrame:
    """user_id, event_id, filled of a stream of user_id, event_id, ts, clear, whose rows come no later than delay after later ones (see LastClear).

    Rows without a user are one user's and have a bucket of their own, -1. (Users and events go without nulls: a null would turn a batch's whole column into floats.)
    """
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(_BUCKETS)))
    user = F.coalesce(F.col("user_id").cast("long"), F.lit(0).cast("long"))
    timed = stream.withWatermark("ts", delay).select("ts", bucket.cast("long").alias("key"), user.alias("user_id"), F.coalesce("event_id", F.lit(_NO_EVENT)).alias("event_id"), "clear", F.unix_micros("ts").alias("us"))
    found = timed.groupBy("key").transformWithStateInPandas(LastClear(), "key long, user_id long, event_id long, filled double", "Append", "EventTime")
    return found.select(F.when(F.col("key") >= 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") != _NO_EVENT, F.col("event_id")).alias("event_id"), "filled")
