"""Near duplicates by MinHash: universal hash minima, banding, signature verification, full-set confirmation, components.

Texts with the same words are one class from the start. A bucket (equal minima in a band) doesn't give all its pairs.
In a few rounds every member is held against some leaders of its buckets only, and links are joined into components; a
bucket whose members all lie in one component is done. Of the buckets that stay mixed, blocks of members are compared by
signature inside a task; texts travel only for members with a plausible partner in another component, and a task confirms
them by their full sets. So the components are those of all pairs that share a bucket, while the rows made follow the
number of members.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_keys, written
from .components import merged
from .textarrays import bytes_of, mix64, shingles, slices, words

#: A group of pairs with one first member is dealt out in parts of about this many.
PART = 256
#: Rounds of leaders before blocks are compared; members of a bucket, and bytes of their texts, that one task compares with as many others.
ROUNDS, BLOCK, BYTES = 3, 1024, 16 << 20
#: A round of leaders that links fewer than one in so many of its plausible pairs is the last one.
FEW = 4
#: Minima that blocks compare first.
LANES = 64


def _hashes(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of count functions a * x + b modulo 2**32."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, count, dtype=np.uint32)


def minima(shingle_set: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each universal hash over a set of 64-bit hashes."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), block):
        np.minimum(out, (a[:, None] * x[None, at : at + block] + b[:, None]).min(axis=1), out=out)
    return out


def _sequence_keys(hashes: np.ndarray, edges: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's word sequence."""
    sizes = np.diff(edges)
    order = np.arange(seed, seed + len(hashes), dtype=np.uint64) - np.repeat(edges[:-1], sizes).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + mix64(order)), dtype=np.uint64)])
    return mix64(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """rid, sid (see common.row_keys), doc_id, key and other (hashes of the word sequence, null without words), n_bytes, n_shingles, bands (a hash for each), sketch (16 bits of each minimum)."""
    names = ["rid", "sid", "doc_id", "key", "other", "n_bytes", "n_shingles", "bands", "sketch"]
    a, b = _hashes(bands * rows, seed)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            data, offsets = bytes_of(batch.column(3))
            hashes, begins, _ = words(data, offsets)
            edges = np.searchsorted(begins, offsets)
            sizes, mins = [], []
            for s in shingles(hashes, begins, offsets, n):
                sizes.append(len(s))
                mins.append(minima(s, a, b))
            mins = np.stack(mins)
            folded = np.zeros((len(mins), bands), np.uint64)
            for r in range(rows):
                folded = mix64(folded + mins[:, r::rows].astype(np.uint64) * np.uint64(2) + np.uint64(1))
            folded = (folded & ~np.uint64(255)) | np.arange(bands, dtype=np.uint64)  # buckets of different bands stay apart
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, folded.size + 1, bands, dtype=np.int32)), pa.array(folded.view(np.int64).reshape(-1)))
            sketch = pa.array([r.tobytes() for r in mins.astype("<u2")], pa.binary())
            keys = [pa.array(_sequence_keys(hashes, edges, seed), mask=np.diff(edges) == 0) for seed in (0, 1 << 40)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *keys, pa.array(np.diff(offsets)), pa.array(sizes, pa.int64()), lists, sketch], names=names)

    schema = "rid long, sid long, doc_id long, key long, other long, n_bytes long, n_shingles long, bands array<long>, sketch binary"
    return docs.select(*row_keys(), "doc_id", "text").mapInArrow(signed, schema)


def _keyed_apart(signed: DataFrame) -> DataFrame:
    """signed, where texts of different words that share key by chance have different ones: `other` tells them apart."""
    apart = signed.where("key is not null").groupBy(F.col("key").alias("_key")).agg(F.min("other").alias("_least"), F.max("other").alias("_most")).where("_least <> _most")
    if apart.isEmpty():
        return signed
    again = F.when(F.col("_least").isNull() | (F.col("other") == F.col("_least")), F.col("key")).otherwise(F.xxhash64("key", "other"))
    return written(signed.join(apart, F.col("key") == F.col("_key"), "left").withColumn("key", again).select(*signed.columns), "keyed-apart")


def _agreement(equal: np.ndarray) -> np.ndarray:
    """How many of each row's flags are set; eight flags are added at a time."""
    if equal.shape[1] % 8 or equal.shape[1] > 255:
        return np.count_nonzero(equal, axis=1)
    lanes = np.ascontiguousarray(equal).view(np.uint64).sum(axis=1)
    return (lanes * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets; a stable sort merges two sorted runs."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose signatures agree in a share of least or more."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(bytes_of(batch.column(i))[0], "<u2").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1)) for i in (2, 3))
            keep = _agreement(x == y) >= least * x.shape[1]
            yield batch.select([0, 1]).filter(pa.array(keep))

    side = lambda c: classes.select(F.col("key").alias(c), F.col("sketch").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")
    return both.mapInArrow(agreeing, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. b's text travels once for each pair, a's once for each part."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in slices(batches, 3):
            data, offsets = bytes_of(batch.column(3))
            hashes, begins, _ = words(data, offsets)
            out = []
            for a, part, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingles(hashes, begins, offsets, n), strict=True):
                if a == b:
                    at, first = (a, part), own
                    continue
                assert at == (a, part), "a's text comes first"
                both = _shared(first, own)
                if 100 * both >= percent * (len(first) + len(own) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    members = pairs.join(sizes, "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_parts")))
    firsts = members.select("a", F.col("a").alias("b"), "_parts", "_part").distinct()
    wanted = members.select("a", "b", "_parts", "_part").union(firsts).join(texts.withColumnRenamed("key", "b"), "b")
    ordered = wanted.select("a", "_part", "b", "text").repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("a") != F.col("b"), "b")
    return ordered.mapInArrow(linked, "a long, b long")


def _leaders(members: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of a bucket's leader and each member of another component; which member leads differs by round and by a third of the bands."""
    order = F.xxhash64("key", F.pmod(F.col("band").bitwiseAND(255), F.lit(3)), F.lit(number))
    leading = members.groupBy("band").agg(F.min_by(F.struct("key", "label"), order).alias("_lead"))
    met = members.join(leading, "band").where("label <> _lead.label").select(F.col("_lead.key").alias("a"), F.col("key").alias("b"))
    return met.distinct()


def _mixed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(band, key, label) of the buckets whose members lie in several components; label is a class's component."""
    labelled = members.select("band", "key").join(joined, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("component", "key").alias("label"))
    apart = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    return written(labelled.join(apart, "band", "left_semi"), "mixed")


class Members(NamedTuple):
    """Rows of mixed buckets as arrays: signatures, bucket hashes, and a number each."""

    sketch: np.ndarray
    own: np.ndarray
    keys: np.ndarray
    blocks: np.ndarray
    sizes: np.ndarray

    def part(self, a: int, b: int) -> Members:
        return Members(*(x[a:b] for x in self))


def _members(group: pd.DataFrame) -> Members:
    return Members(np.frombuffer(b"".join(group["sketch"]), "<u2").reshape(len(group), -1), np.stack(list(group["bands"])), *(group[c].to_numpy() for c in ("key", "block", "n_shingles")))


def _plausible_in_block(rows: Members, labels: np.ndarray, band: int, low: int, high: int, least: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of block low, the rows of block high that may be alike and share no band before this one; by labels as they are when asked.

    The low bytes of LANES minima are compared first: they differ only where the minima do, so a row with more of them
    than all minima may have is out, and the rest is compared for few rows.
    """
    sketch, own, keys, blocks, sizes = rows
    second = np.flatnonzero(blocks == high)
    second = second[np.argsort(keys[second])]
    width, lanes = sketch.shape[1], min(LANES, sketch.shape[1] // 8 * 8)
    differ = width - least * width
    short = np.ascontiguousarray(sketch[:, :lanes].astype(np.uint8))
    near, near_sizes = short[second], sizes[second]
    for k, i in enumerate((second if low == high else np.flatnonzero(blocks == low)).tolist()):
        from_ = k + 1 if low == high else 0  # within a block each pair once
        others, other_sizes = second[from_:], near_sizes[from_:]
        # Sets too different in size can't be alike.
        likely = (100 * np.minimum(other_sizes, sizes[i]) >= percent * np.maximum(other_sizes, sizes[i])) & (labels[others] != labels[i])
        if lanes:
            likely &= lanes - _agreement(near[from_:] == short[i]) <= differ
        at = others[likely]
        at = at[_agreement(sketch[at] == sketch[i]) >= least * width]
        # By the hashes that made the buckets: a band of the sketch may agree where its minima don't.
        first = (own[at] == own[i]).argmax(axis=1)
        yield i, at[own[i][first] == band]


def _group_edges(table: pa.Table) -> list[int]:
    """Where the groups (band, low, high) of an ordered table begin."""
    columns = [table.column(c).to_numpy() for c in ("band", "low", "high")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new).tolist() or [0]


def _with_partners(table: pa.Table, edges: list[int], least: float, percent: int) -> pa.RecordBatch:
    """The rows of whole groups, from each of edges to the next, that have a plausible partner in their group."""
    column = lambda c: table.column(c).combine_chunks()
    n = table.num_rows
    numbers = {c: column(c).to_numpy(zero_copy_only=False) for c in ("band", "low", "high", "block", "key", "label", "n_shingles")}
    rows = Members(np.frombuffer(bytes_of(column("sketch"))[0], "<u2").reshape(n, -1), column("bands").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), numbers["key"], numbers["block"], numbers["n_shingles"])
    on = np.zeros(n, bool)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for i, partners in _plausible_in_block(rows.part(a, b), numbers["label"][a:b], *(numbers[c][a] for c in ("band", "low", "high")), least, percent):
            if len(partners):
                on[a + i] = on[a + partners] = True
    names = ["band", "low", "high", "block", "key", "label"]
    return pa.RecordBatch.from_arrays([pa.array(numbers[c][on], pa.int64()) for c in names], names=names)


def _across(mixed: DataFrame, classes: DataFrame, texts: DataFrame, least: float, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of mixed buckets: each plausible pair is confirmed in the first band it shares.

    A bucket is compared in blocks that meet pairwise, of BLOCK members and BYTES of text at most (or one text). A first
    pass looks at signatures alone and names the members that have a plausible partner; only their texts are joined, and a
    second pass confirms pairs by full sets. A pair whose components a link of the task has joined already is left out, so
    a task gives fewer links than it has members.
    """
    columns = ["band", "low", "high", "block", "key", "label", "n_shingles", "bands", "sketch"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with a plausible partner; most groups are small, so whole batches of them become arrays at once."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            edges = _group_edges(table)
            held = table.slice(edges[-1])  # the last group may go on in the next batch
            if edges[-1]:
                yield _with_partners(table.slice(0, edges[-1]), edges, least, percent)
        if held is not None and held.num_rows:
            yield _with_partners(held, [0, held.num_rows], least, percent)

    def compared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, labels, out, sets = group["key"].to_numpy(), group["label"].to_numpy().copy(), [], {}

        def own(i: int) -> np.ndarray:
            if i not in sets:
                data, offsets = bytes_of(pa.array([group["text"].iloc[i]], pa.large_string()))
                hashes, begins, _ = words(data, offsets)
                sets[i] = next(shingles(hashes, begins, offsets, n))
            return sets[i]

        for i, partners in _plausible_in_block(_members(group), labels, *key, least, percent):
            for j in partners.tolist():
                if labels[j] != labels[i]:
                    both = _shared(own(i), own(j))
                    if 100 * both >= percent * (len(own(i)) + len(own(j)) - both):
                        out.append((keys[i], keys[j]))
                        labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    described = mixed.join(classes.select("key", "n_bytes", "n_shingles", "bands", "sketch"), "key")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_bytes") / BYTES))
    sizes = mixed.join(classes.select("key", "n_bytes"), "key").groupBy("band").agg(parts.alias("blocks"))
    placed = described.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).select(*columns)
    met = met.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    wanted = written(met.mapInArrow(named, "band long, low long, high long, block long, key long, label long"), "plausible")
    full = wanted.join(classes.select("key", "n_shingles", "bands", "sketch").join(texts, "key"), "key").select(*columns, "text")
    return full.groupBy("band", "low", "high").applyInPandas(compared, "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable, itself included), kept, rid and sid (see common.row_keys), representative.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of word shingles (A-Z lower-cased, words
    end at white space). A document of fewer words has its whole sequence as its one shingle; one without words or text
    has none and links with nothing. Rows that repeat a doc_id are held each by its own text; kept says doc_id =
    component_id, representative marks one (doc_id, text) of each group. Columns besides doc_id and text are not read.
    bands * rows minima: a pair at the threshold misses all buckets with probability (1 - s**rows)**bands, below 1e-8 at
    0.85 and below 1e-5 at 0.8. No bucket is capped.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (bands * rows)) ** 0.5
    signed = _keyed_apart(written(signatures(docs, words_per_shingle, bands, rows, seed), "minhash"))
    # One class for each word sequence; everything up to the result is about classes.
    classes = written(signed.where("key is not null").groupBy("key").agg(F.first(F.struct("rid", "sid", "n_bytes", "n_shingles", "bands", "sketch")).alias("c")).select("key", "c.*"), "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = written(banded.join(buckets, "band", "left_semi"), "members")
    wanted = members.select("key").distinct().join(classes.select("key", "rid", "sid"), "key")
    texts = written(docs.select(*row_keys(), "text").join(wanted, ["rid", "sid"]).dropDuplicates(["key"]).select("key", "text"), "texts")
    mixed, checked, joined, few = members.withColumn("label", F.col("key")), None, None, False
    for number in range(ROUNDS + 1):
        last = few or number == ROUNDS
        if last:
            new = _across(mixed, classes, texts, least, words_per_shingle, percent)
        else:
            pairs = _leaders(mixed, number)
            pairs = written(_plausible(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), classes, least), "pairs")
            checked = pairs if checked is None else checked.union(pairs)
            new = _confirmed(pairs, texts, words_per_shingle, percent)
        new = written(new, "links")
        joined = merged(joined, new.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if last:
            break
        few = FEW * new.count() < pairs.count()  # more leaders would link as little
        mixed = _mixed(mixed, joined)
        if mixed.isEmpty():
            break
    label = F.coalesce("component", "key")
    rows_ = signed.select("rid", "sid", "doc_id", "key", "n_shingles").join(joined, F.col("key") == F.col("node"), "left").withColumn("label", label)
    # Documents without words stand alone; the others get the least of their group, found by an aggregate.
    least_of = rows_.where("key is not null").groupBy(F.col("label").alias("_label")).agg(F.min(F.struct("doc_id", "rid")).alias("_least"))
    ended = rows_.join(least_of, (F.col("label") == F.col("_label")) & F.col("key").isNotNull(), "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("_least.doc_id"))
    alone = F.col("key").isNull() | ((F.col("rid") == F.col("_least.rid")) & F.col("doc_id").eqNullSafe(F.col("_least.doc_id")))
    return ended.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "rid", "sid", alone.alias("representative"))


def deduplicated(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs, all columns, with one document of each group: the least doc_id. Rows that repeat id and text count as one."""
    kept = near_duplicates(docs, words_per_shingle, percent, **options).where("representative").select("rid", "sid").distinct()
    rid, sid = row_keys()
    rows = docs.select(rid.alias("_rid"), sid.alias("_sid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return rows.join(kept, (F.col("_rid") == F.col("rid")) & (F.col("_sid") == F.col("sid")), "left_semi").dropDuplicates(["_rid", "_sid"]).select("_doc.*")
