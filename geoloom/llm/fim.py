"""Fill-in-the-middle: texts cut at code points that a learned rank index finds in their UTF-8 bytes.

The index of a text maps the rank of a code point boundary to its byte offset: line segments that miss no offset by more
than a bound, and for every boundary the small residual that makes the prediction exact. A cut is looked up as segment,
prediction and residual; the bytes are never scanned again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textarrays import bytes_of, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)


class RankIndex:
    """Byte offsets of all code point boundaries of a text, as segments of bounded error and residuals.

    A segment grows while some line through its first offset misses none of its offsets by more than error: each offset
    leaves an interval of slopes, and the segment ends where the intervals have nothing in common. The intervals are
    worked off in blocks that double in length, so that a text of n code points takes O(n) array steps.
    """

    def __init__(self, offsets: np.ndarray, error: int = 60):
        n, at = len(offsets), 0
        starts, slopes = [], []
        while at < n:
            low, high, to, step = -np.inf, np.inf, at + 1, 64
            while to < n:
                end = min(to + step, n)
                run, rise = np.arange(to - at, end - at), offsets[to:end] - offsets[at]
                least = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                most = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                over = least > most
                stop = int(np.argmax(over)) if over.any() else end - to
                if stop:
                    low, high = float(least[stop - 1]), float(most[stop - 1])
                to += stop
                if to < end:
                    break
                step *= 2
            starts.append(at)
            slopes.append((low + high) / 2 if to > at + 1 else 0.0)
            at = to
        self.starts, self.slopes, self.bases = np.array(starts), np.array(slopes), offsets[starts]
        ranks = np.arange(n)
        self.residuals = (offsets - self._predicted(ranks, np.repeat(np.arange(len(starts)), np.diff([*starts, n])))).astype(np.int8)

    def _predicted(self, ranks, segments):
        return self.bases[segments] + np.rint(self.slopes[segments] * (ranks - self.starts[segments])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """The byte offset of boundary rank (0 is the text's begin, n its end)."""
        segment = int(np.searchsorted(self.starts, rank, "right")) - 1
        return int(self._predicted(rank, segment)) + int(self.residuals[rank])


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets of the code points of a UTF-8 text, and its length."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _arranged(data: bytes, cuts: tuple[int, int], suffix_first: bool) -> bytes:
    prefix, middle, suffix = data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :]
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if suffix_first else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every document, whole, for fill-in-the-middle training.

    The first four 8-digit groups of the hex SHA-256 of `seed:doc_id` decide: two cuts among the n + 1 boundaries of the
    text, then whether it stays plain, then whether the suffix goes first (spm) or the prefix (psm). Texts that are empty
    or hold a mark stay plain. A null text is empty, a null doc_id an empty one; rows that repeat both are treated
    alike; other columns are left alone; an empty table gives no row. No shuffle: a document is worked on where it is
    read, a text at a time, in memory of about ten times its bytes.
    """
    bounded_batches(docs.sparkSession)
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.substring(hashed, 1, 32).alias("draw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, limit=4 << 20):
            data, edges = bytes_of(batch.column(1))
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for a, b, draw in zip(edges[:-1].tolist(), edges[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                own, h = data[a:b], [int(draw[k : k + 8], 16) for k in range(0, 32, 8)]
                text = own.tobytes()
                at = boundaries(own)
                n = len(at) - 1
                counts.append(n)
                if not n or h[2] % 100 >= 100 - plain_percent or any(m in text for m in MARKS):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                index = RankIndex(at)
                forms.append("spm" if h[3] % 100 < spm_percent else "psm")
                prefixes.append(first)
                middles.append(last - first)
                outputs.append(_arranged(text, (index.offset(first), index.offset(last)), forms[-1] == "spm"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text again, from output and form alone. A mark begins with its only `<`, so none can arise across a seam."""
    head, tail = F.substring_index(output, MIDDLE.decode(), 1), F.substring_index(output, MIDDLE.decode(), -1)
    after = lambda mark: F.substring_index(head, mark.decode(), -1)
    first = lambda mark, other: F.substring_index(F.substring_index(head, other.decode(), 1), mark.decode(), -1)
    psm = F.concat(first(PREFIX, SUFFIX), tail, after(SUFFIX))
    spm = F.concat(after(PREFIX), tail, first(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
