"""Quality by ordinal regression: cumulative links over shared hashed-text weights with ordered thresholds.

P(grade > k) = sigmoid(score - threshold k) for every k; the score is one weighted sum of hashed features, so the grades
share all weights and differ in thresholds only. It gives the expected grade and the tail probability to select by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, least_hashed, written
from .textarrays import NO_LETTER, bytes_of, mix64, slices, words

BITS = 22
#: Words count whole and by so many first bytes.
STEMS = (4, 6)
_UPPER = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_MARK = NO_LETTER & ~_DIGIT & ~_GAP
_LINE = np.isin(np.arange(256), [10])
#: Steps of a share that has a feature of its own.
_STEPS = np.array([0.002, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct feature: its letter words, their stems, and steps of what it is made of (capitals, marks, digits, lines, repeats).

    wanted: which buckets to look for; the others are left out before anything is sorted.
    """
    n = len(offsets) - 1
    hashes, begins, _, *stems = words(data, offsets, NO_LETTER, STEMS)
    edges = np.searchsorted(begins, offsets)
    which = np.repeat(np.arange(n, dtype=np.uint64), np.diff(edges)) << np.uint64(BITS)

    def distinct(names: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.unique(which | names)
        hit = wanted[names]
        return np.unique(which[hit] | names[hit])

    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(_per_text(~NO_LETTER[data], offsets), 1)
    total = np.maximum(np.diff(edges), 1)
    different = np.bincount((np.unique(which | hashes >> np.uint64(64 - BITS)) >> np.uint64(BITS)).astype(np.int64), minlength=n)
    shares = [
        _per_text(_UPPER[data], offsets) / letters, _per_text(_MARK[data], offsets) / size, _per_text(_DIGIT[data], offsets) / size,
        _per_text(_GAP[data], offsets) / size, 10 * _per_text(_LINE[data], offsets) / total, different / total, letters / total / 20, np.log2(total + 1) / 16,
    ]
    made = [distinct(hashes >> np.uint64(64 - BITS)), *(distinct(mix64(h + np.uint64(k)) >> np.uint64(64 - BITS)) for k, h in zip(STEMS, stems, strict=True))]
    for kind, share in enumerate(shares):
        step = np.searchsorted(_STEPS, share).astype(np.uint64)
        name = mix64(np.uint64(1000 * kind + 77) + step) >> np.uint64(64 - BITS)
        made.append(np.arange(n, dtype=np.uint64) << np.uint64(BITS) | name)
    keys = np.unique(np.concatenate(made))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by bucket and which there are, made once a process."""
        if not hasattr(self, "_made"):
            table = np.zeros(1 << BITS, np.float32)
            table[self.buckets] = self.weights
            self._made = table, table != 0
        return self._made

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The weighted sum of each text's features."""
        table, wanted = self._tables()
        which, bucket = features(data, offsets, wanted)
        return np.bincount(which, weights=table[bucket], minlength=len(offsets) - 1)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...; falls with k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -40, 40)))


def telling(counts: np.ndarray, sizes: np.ndarray, least_g: float = 30.0, least_lift: float = 12.0) -> np.ndarray:
    """Which features (rows of counts, a column a grade) tell grades of these sizes apart.

    Their likelihood-ratio statistic (G) is beyond chance, and one grade has them several times as often as another: what
    only follows a text's length is in all of them.
    """
    seen, sizes = counts.astype(float), np.maximum(sizes, 1).astype(float)
    expected = seen.sum(axis=1, keepdims=True) * sizes / sizes.sum()
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    g = 2 * (term(seen, expected) + term(sizes - seen, sizes - expected)).sum(axis=1)
    rate = (seen + 0.5) / (sizes + 1)
    return (g >= least_g) & (rate.max(axis=1) / rate.min(axis=1) >= least_lift)


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, steps: int = 300, decay: float = 2e-4) -> OrdinalModel:
    """The likeliest weights of the features in rows and thresholds (Adam, weights decay), every grade with the same weight in all.

    Thresholds are a first one and positive gaps, so that they stay ordered.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, bucket = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    n, at = len(names), np.arange(len(rows))
    each = 1 / np.maximum(np.bincount(grades, minlength=top + 1), 1) / max(1, len(np.unique(grades)))
    share = each[grades]
    theta = np.zeros(n + top)
    theta[n] = -1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, first, gaps = theta[:n], theta[n], np.exp(theta[n + 1 :])
        cut = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, weights=w[bucket], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(cut[None] - score[:, None], -40, 40)))  # P(grade > k)
        full = np.hstack([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))])
        chance = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        slope = full * (1 - full)
        g_score = -share * (slope[at, grades] - slope[at, grades + 1]) / chance
        g_cut = np.array([(share * slope[:, k + 1] * ((grades == k + 1).astype(float) - (grades == k)) / chance).sum() for k in range(top)])
        g = np.concatenate([np.bincount(bucket, weights=g_score[row], minlength=n) + decay * w, [g_cut.sum()], [g_cut[k:].sum() * gaps[k - 1] for k in range(1, top)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return OrdinalModel(names, theta[:n].astype(np.float32), theta[n] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n + 1 :]))]))


def train(docs: DataFrame, graded: DataFrame, top: int, per_grade: int = 3000) -> OrdinalModel | None:
    """A model from graded (doc_id, grade in 0..top): the per_grade rows of each grade with the least hash of doc_id.

    None without graded documents, or where no feature tells the grades apart: then nothing is known. Null grades and
    grades outside are left out; the sample doesn't follow the corpus.
    """
    bounded_batches(docs.sparkSession)
    known = graded.where(F.col("grade").between(0, top)).select("doc_id", F.col("grade").cast("int").alias("grade")).distinct()
    sample = least_hashed(known, "grade", "doc_id", per_grade, 3)
    # The sample has (top + 1) * per_grade rows at most, so it goes to where the texts are.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            which, bucket = features(*bytes_of(batch.column(1)))
            edges = np.searchsorted(which, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket.astype(np.int32)))], names=["doc_id", "grade", "buckets"])

    found = written(chosen.mapInArrow(made, "doc_id long, grade int, buckets array<int>"), "features")
    sizes = np.array([r["n"] for r in found.groupBy("grade").agg(F.count("*").alias("n")).join(found.sparkSession.range(top + 1), F.col("grade") == F.col("id"), "right").orderBy("id").select(F.coalesce("n", F.lit(0)).alias("n")).collect()])
    if not sizes.sum():
        return None
    each = found.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*[F.count_if(F.col("grade") == k).alias(f"g{k}") for k in range(top + 1)])
    # Buckets number 2 ** BITS at most, and few are frequent enough to tell anything.
    counts = each.where(" + ".join(f"g{k}" for k in range(top + 1)) + " >= 8").toArrow()
    if not counts.num_rows:
        return None
    names = np.asarray(counts.column("bucket"))[telling(np.stack([np.asarray(counts.column(f"g{k}")) for k in range(top + 1)], axis=1), sizes)]
    if not len(names):
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x[np.isin(x, names)] for x in (np.asarray(v.values) for v in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "grade", "buckets"])

    got = found.mapInArrow(cut, found.schema).toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    rows = [np.asarray(x.values) for x in got.column("buckets").combine_chunks()]
    return fit(rows, np.asarray(got.column("grade")).astype(np.int64), top)


def grade(docs: DataFrame, model: OrdinalModel | None, at_least: int, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (the probability of grade at_least or more), kept (tail of least or more), row by row.

    A null text is scored as an empty one. Without a model nothing is known: null grade and tail, kept true.
    """
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            p = model.above(model.score(*bytes_of(batch.column(1))))
            tail = p[:, at_least - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, expected_grade double, tail double, kept boolean")


def kept(docs: DataFrame, model: OrdinalModel | None, at_least: int, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose tail is least or more. Runs where the documents are read, without a join."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            p = model.above(model.score(*bytes_of(batch.column(at))))
            yield batch.filter(pa.array(p[:, at_least - 1] >= least))

    return docs.mapInArrow(chosen, docs.schema)


def grade_of_labels(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: well-formed but toxic, 2: good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)
