"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One linear classifier a bit, over hashed byte trigrams, predicts it; a text gets
the language whose codeword has the least weighted logistic loss against all bits, and a flag when two are close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, least_hashed, written
from .textarrays import LOWER, STEP, bytes_of, slices

#: Texts counted at once: each has a row of buckets.
ROWS = 256


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +-1. Up to seven languages have all splits in two; more have random bits, the draw whose two nearest rows are farthest apart."""
    if k <= 7:
        splits = range(1, 1 << max(0, k - 1))
        return np.array([[1 if j == 0 or not s >> (j - 1) & 1 else -1 for s in splits] for j in range(k)], np.float32).reshape(k, -1)
    draw, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.float32), (k, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of hashed byte trigrams (A-Z lower-cased, padded with zeros at the end of a text), a row a text."""
    n = len(offsets) - 1
    counts = np.zeros(n * buckets, np.int64)
    shift = np.uint32(32 - int(np.log2(buckets)))
    for at in range(0, len(data), STEP):
        to = min(at + STEP, len(data))
        low = np.zeros(to - at + 2, np.uint32)
        more = LOWER[data[at : min(to + 2, len(data))]]
        low[: len(more)] = more
        which = np.searchsorted(offsets, np.arange(at, to, dtype=np.int64), "right") - 1 if n > 1 else np.zeros(to - at, np.int64)
        left = offsets[which + 1] - np.arange(at, to)
        key = low[:-2] | np.where(left > 1, low[1:-1], 0).astype(np.uint32) << np.uint32(8) | np.where(left > 2, low[2:], 0).astype(np.uint32) << np.uint32(16)
        bucket = (key * np.uint32(2654435761)) >> shift
        counts += np.bincount(which * buckets + bucket, minlength=n * buckets)
    return counts.reshape(n, buckets)


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its probability, by how much it leads) for each row of counts."""
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = share.astype(np.float32) @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        chance = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(chance, axis=1)
        lead = top[:, -1] - top[:, -2] if chance.shape[1] > 1 else top[:, -1]
        return best, chance[np.arange(len(best)), best], lead


def fit(counts: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 300, decay: float = 1e-3) -> LanguageModel:
    """Logistic regression for every bit of the code, all by the same gradient steps (Adam)."""
    code = codewords(len(langs))
    share = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    scale = 1 / (share.std(axis=0) + 1e-4)
    x, goal = (share - (mean := share.mean(axis=0))) * scale / np.sqrt(share.shape[1]), code[labels]
    sizes = np.bincount(labels, minlength=len(langs))
    weight = (1 / np.maximum(sizes, 1))[labels][:, None] / len(langs)
    theta = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        pull = -goal * weight / (1 + np.exp(np.clip((x @ theta[:-1] + theta[-1]) * goal, -30, 30)))
        g = np.vstack([x.T @ pull + decay * 1e-2 * theta[:-1], pull.sum(axis=0)]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w = theta[:-1] * (scale / np.sqrt(share.shape[1]))[:, None]
    right = ((x @ theta[:-1] + theta[-1]) * goal > 0).mean(axis=0)
    # A bit counts by how far its classifier is from guessing.
    trust = np.maximum(right - 0.5, 0.01)
    return LanguageModel(langs, code, w.astype(np.float32), theta[-1] - mean @ w, (trust / trust.sum() * code.shape[1]).astype(np.float32))


def train(docs: DataFrame, per_lang: int = 600, buckets: int = 4096, most_rows: int = 12000) -> LanguageModel | None:
    """A model of the languages of docs (doc_id, text, lang), from the per_lang rows of each with the least hash of doc_id.

    Rows of null lang or text are left out; None if nothing is left. With very many languages each has fewer rows, so that
    all together have about most_rows at most. The sample's size doesn't follow the corpus.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null")
    number = known.select("lang").distinct().count()
    per_lang = max(1, min(per_lang, most_rows // max(1, number)))
    ids = written(least_hashed(known.select("doc_id", "lang"), "lang", "doc_id", per_lang, 1).distinct(), "language-sample")
    # The ids go to where the texts are, unless languages are so many that even a row each is a large table.
    few = number * per_lang <= 4 * most_rows
    chosen = known.join(F.broadcast(ids) if few else ids, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, rows=ROWS):
            counts = np.minimum(trigrams(*bytes_of(batch.column(1)), buckets), (1 << 31) - 1)
            row, at = np.nonzero(counts)
            edges = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (at, counts[row, at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["lang", "bucket", "times"])

    rows = chosen.mapInArrow(counted, "lang string, bucket array<int>, times array<int>").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    rows.sort(key=lambda r: (r["lang"], r["bucket"], r["times"]))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(rows), buckets), np.uint32)
    for row, r in zip(counts, rows, strict=True):
        row[r["bucket"]] = r["times"]
    return fit(counts, np.array([place[r["lang"]] for r in rows]), langs)


def identify(docs: DataFrame, model: LanguageModel | None, least_lead: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each document, from its whole text alone.

    `und` with score 0 for a null text, one without a letter, or without a model. ambiguous: the best language leads the
    next by less than least_lead. Rows that repeat are predicted each.
    """
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    buckets = len(model.weights)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, rows=ROWS):
            best, chance, lead = model.predict(trigrams(*bytes_of(batch.column(1)), buckets))
            known = np.asarray(batch.column(2).fill_null(False))
            langs = pa.array([model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, pa.array(np.where(known, chance, 0.0).astype(np.float64)), pa.array((lead < least_lead) | ~known)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    letters = F.col("text").rlike(r"\p{L}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("_letters")).mapInArrow(predicted, "doc_id long, lang_pred string, score double, ambiguous boolean")
