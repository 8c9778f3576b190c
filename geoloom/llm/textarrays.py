"""Texts of an Arrow column as byte arrays, cut into words and hashed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; all arrays of one step together are some fifty times as large.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All but ASCII letters and bytes of other characters.
NO_LETTER = ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + 4096)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, _WRAP))]
    return _powers[0][:n], _powers[1][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)
    if column.null_count:  # a null may cover bytes
        sizes = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if (sizes != np.diff(at)).any():
            return bytes_of(column.fill_null(""))
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = STEP, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """The batches again, in parts of at most so many rows whose texts hold limit bytes at most, or a single text."""
    for batch in batches:
        _, offsets = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hashes, begins, ends) of the words of all texts, A-Z lower-cased; equal words have equal hashes.

    gaps: the bytes between words. For each of prefixes follows an array of hashes of the words' first so many bytes.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    found, at = [], 0
    while at < len(data):
        to = min(at + STEP, len(data))
        if to < len(data):  # end between words or texts
            to = _next_break(data, first, gaps, to)
        part = data[at:to]
        gap = gaps[part]
        begin, end = ~gap, ~gap
        begin[1:] &= gap[:-1] | first[at + 1 : to]
        end[:-1] &= gap[1:] | first[at + 1 : to]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, inverse = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        hashed = lambda stop, b=begin, s=sums, i=inverse: mix64((s[stop] - s[b]) * i[b])
        found.append((hashed(end), begin + at, end + at, *(hashed(np.minimum(begin + k, end)) for k in prefixes)))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _next_break(data: np.ndarray, first: np.ndarray, gaps: np.ndarray, at: int) -> int:
    step = 4096
    while at < len(data):
        to = min(at + step, len(data))
        near = np.flatnonzero(first[at:to] | gaps[data[at:to]])
        if len(near):
            return at + int(near[0])
        at, step = to, 2 * step
    return len(data)


def shingles(hashes: np.ndarray, begins: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of n words; of its whole sequence if that is shorter, none without words."""
    edges = np.searchsorted(begins, offsets)
    run = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        run = mix64(run + hashes[k : k + len(run)] * np.uint64(2 * k + 3))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(run[a : b - n + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix64(h + hashes[k : k + 1] * np.uint64(2 * (k - a) + 5))
            yield h
        else:
            yield np.zeros(0, np.uint64)
