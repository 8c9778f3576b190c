"""Packing documents into sequences by minimum bin slack.

Every document is cut into full windows and one remainder. Only the number of remainders of each length is needed to
plan: for the longest one left, a bit set of reachable sums over the other lengths (with their counts) finds the fill
closest to the window, and walking the sets backwards gives how many of each length it takes. A pattern is used as often
as its counts allow, which uses up one length, so a plan has at most window - 1 patterns whatever the size of the corpus.
Pieces then take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer file at path, as encode(text, add_special_tokens=False) gives them.

    The merges of a byte-level BPE file are also its ranks, so the ids come from tiktoken's faster loop over the same
    vocabulary and pattern; other files go through `tokenizers` itself. A fixed probe compares both once a process.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        plain = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        _encoders[path] = plain
        if path == public_tokenizers.path("byte_bpe_50k.json"):
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
            back = {c: b for b, c in letters.items()}
            special = {a.content: i for i, a in own.get_added_tokens_decoder().items()}
            ranks = {bytes(back[c] for c in word): i for word, i in own.get_vocab(with_added_tokens=False).items() if word not in special}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            quick = lambda text: fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            probe = "It's 3½ o'clock,  naïve — 东京\n\n<|endoftext|> \t<b>x</b>  "
            if np.array_equal(plain(probe), quick(probe)):
                _encoders[path] = quick
    return _encoders[path]


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """The pieces of every document (see PIECE_SCHEMA): full windows, then what remains.

    A null or empty text has the end id alone. Runs where the documents are read, without a shuffle.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                doc, n, raw = doc.as_py(), len(ids), ids.tobytes()
                rows += [(doc, at, min(window, n - at), zlib.crc32(raw[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length sum to the largest total that capacity allows."""
    within = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... pieces at a time
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of such sequences), each piece used once."""
    counts, patterns = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = closest_fill(counts, window - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        patterns.append((fill, times))
        for k, n in fill.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, rows_per_bin: int = 1000) -> DataFrame:
    """One row per piece: PIECE_SCHEMA with sequence_id and offset.

    Rows that repeat a document are packed each for itself; an empty table gives no row. Sequences are numbered from 0
    without gaps, and each one is filled from offset 0 without gaps.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = written(cut(docs, tokenizer, window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    bins = spark.createDataFrame([(k, -(-n // rows_per_bin)) for k, n in counts.items()], "_l long, _bins long")  # a row for each length
    places, sequence, used = [], 0, {}
    for fill, times in plan(counts, window):
        offset = 0
        for length, n in sorted(fill.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + n * times
            places.append((length, first, used[length], n, sequence, offset))
            offset += length * n
        sequence += times
    placed = spark.createDataFrame(places, "_length long, _first long, _last long, _each long, _sequence long, _offset long")
    # The rank among pieces of one length: a row number within a salted bin, after the pieces of the bins before it. A
    # length has as many bins as its pieces ask for, so a frequent one is dealt out and a rare one is one group.
    salted = pieces.join(F.broadcast(bins), F.col("length") == F.col("_l")).withColumn("_bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_bins"))).drop("_l", "_bins")
    order = Window.partitionBy("length", "_bin").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1).join(starts, ["length", "_bin"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    # A plan has at most window patterns of few lengths each: its size doesn't follow the corpus.
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    seated = ranked.join(F.broadcast(placed), at)
    which = F.col("_rank") - F.col("_first")
    return seated.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(which / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(which, F.col("_each")) * F.col("length")).alias("offset"),
    )
