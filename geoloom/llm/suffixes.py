"""Repeated byte strings by a sparse suffix array, sorted deep-shallow.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. Sorting the suffixes at every byte isn't
needed: in each window of that length the k-byte string with the least hash (the first of equals) is an anchor, and two
equal windows have the same anchor at the same place. So only suffixes at anchors are sorted, once to the right and once,
reversed, to the left; two windows around anchors p and q are equal if the common prefixes to both sides reach their ends.
The anchors of longer windows are among those of shorter ones, so several lengths are answered by one sort.

Suffixes are dealt out by their first k bytes. Those that share them are ordered by multikey quicksort (eight bytes a
character, all groups of a batch at once) down to a shallow depth; what still agrees there has a long common prefix and is
finished by blind tries. The prefixes to the left form a tree; in each of its nodes the neighbours in the right order give
every suffix its longest partner, so that a group costs its size times its depth, not its square. A group too large for a
task is dealt out again by more bytes to the right or to the left: two strings that agree on a whole window meet in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_keys, written
from .textarrays import STEP, bytes_of, mix64, powers, slices

#: Bytes to which multikey quicksort goes before the blind tries take over.
SHALLOW = 64
#: Different surroundings of an anchor that one task sorts; larger groups are dealt out again by more of their bytes.
GROUP = 4096
#: Strings that a task sorts at once, and entries of tree nodes that it looks at at once.
BATCH, ENTRIES = 1 << 14, 1 << 18
SPANS = "rid long, sid long, spans array<struct<begin:bigint,end:bigint,length:int>>"
SORTED = "one long, two long, rid long, sid long, begin long, place int, single boolean, text binary"


# -- anchors ----------------------------------------------------------------------------------------------------------


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes at every place where that many are left."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * inverse[: len(data) - width + 1])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours: running minima from both ends of blocks meet in the middle."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, lengths: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, begin, end, hash) of each anchor: begin..end are the bytes of all windows, of any of the lengths, that have it as theirs."""
    shortest = min(lengths)
    if len(data) < shortest:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    hashes = string_hashes(data, k)
    # The high bits of the hash, then the place: the least is the first of the least. As many bits for every text, so that
    # equal windows choose alike.
    bits = np.uint64(max(24, int(len(hashes)).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    for length in sorted(x for x in lengths if x <= len(data)):
        least = sliding_minimum(keys, length - k + 1)
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        if length == shortest:
            place, begin, end = at[first], first, last + length
        else:  # these are anchors of the shorter windows too, whose bytes lie within these
            i = np.searchsorted(place, at[first])
            begin[i], end[i] = first, last + length
    return place, begin, end, hashes[place]


def _anchor_rows(lengths: Sequence[int], k: int):
    """Rows (rid, sid, text): the anchors. at holds begin in its high half, then the anchor's distance from there and the size."""
    names, longest = ["rid", "sid", "at", "shared", "around"], max(lengths)
    assert longest < 1 << 15, "places are packed"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, limit=STEP):
            data, offsets = bytes_of(batch.column(2))
            rid, sid, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), [[] for _ in names]
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                # A long text in steps: each sees a window's length more to both sides and gives the anchors of its own bytes.
                for at in range(a, max(b - min(lengths) + 1, a), STEP):
                    low = max(at - longest, a)
                    part = data[low : min(at + STEP + longest, b)]
                    place, begin, end, shared = anchors(part, lengths, k)
                    own = (place >= at - low) & (place < at - low + STEP)
                    place, begin, end, shared = place[own], begin[own], end[own], shared[own]
                    if not len(place):
                        continue
                    view = part.tobytes()
                    digest = b"".join([hashlib.blake2b(view[x:y], digest_size=8).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                    around = mix64(np.frombuffer(digest, "<u8").astype(np.uint64) + (place - begin).astype(np.uint64))
                    packed = (begin + (low - a)) << 32 | (place - begin) << 16 | (end - begin)
                    for col, x in zip(parts, (np.full(len(place), rid[i]), np.full(len(place), sid[i]), packed, shared.view(np.int64), around.view(np.int64)), strict=True):
                        col.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=names)

    return found


# -- deep-shallow sorting ---------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branch depths and branching bytes only; a string is compared with one stored string to find its place."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        """A node is (depth, {byte: child}); a leaf is a list of equal strings. -1 stands for the end of a string."""
        if self.root is None:
            self.root = [i]
            return
        s, node = self.strings[i], self.root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common(s, other)
        if shared == len(s) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            parent, node = (node, s[node[0]]), node[1][s[node[0]]]
        byte = s[shared] if shared < len(s) else -1
        if isinstance(node, tuple) and node[0] == shared:
            node[1][byte] = [i]
            return
        fork = (shared, {byte: [i], other[shared] if shared < len(other) else -1: node})
        if parent is None:
            self.root = fork
        else:
            parent[0][1][parent[1]] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def _matrix(data: np.ndarray, start: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes for each string that begins at start and goes forwards (step 1) or backwards (-1); zeros after its end."""
    width = max(8, -(-int(sizes.max(initial=0)) // 8) * 8)
    reach, out = np.arange(width), np.zeros((len(sizes), width), np.uint8)
    for i in range(0, len(sizes), 512):  # places take eight times the room of bytes
        inside = reach[None] < sizes[i : i + 512, None]
        at = start[i : i + 512, None] + step * reach[None]
        out[i : i + 512][inside] = data[at[inside]]
    return out


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the strings (a row each, zeros after its end) by group, then bytes, a string before those it begins.

    groups ascends. Multikey quicksort takes eight bytes for a character and goes down to shallow bytes; strings that are
    equal that far go to a blind trie each group.
    """
    n = len(rows)
    words = rows.view(">u8").astype(np.uint64)
    order, at = np.arange(n), np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    parts = np.repeat(at, np.diff(np.concatenate([at, [n]])))  # the place where each one's part of equal strings begins
    depth = 0
    while True:
        first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        many = np.repeat(np.diff(np.concatenate([first, [n]])), np.diff(np.concatenate([first, [n]]))) > 1
        open_ = np.flatnonzero(many)
        if not len(open_) or depth >= min(shallow // 8, words.shape[1]):
            break
        key = words[order[open_], depth]
        moved = np.lexsort((key, parts[open_]))
        order[open_], key, part = order[open_][moved], key[moved], parts[open_]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        parts[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        depth += 1
    if len(open_):
        edges = np.flatnonzero(np.concatenate([[True], parts[open_][1:] != parts[open_][:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            members = order[open_[a:b]]
            trie = BlindTrie([rows[i, : sizes[i]].tobytes() for i in members.tolist()])
            for i in range(len(members)):
                trie.insert(i)
            order[open_[a:b]] = members[trie.ordered()]
    return order


def neighbours(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each string in order with the next one; -1 where that is of another group."""
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.where(groups[a] == groups[b], np.minimum(length, np.minimum(sizes[a], sizes[b])), -1).astype(np.int32)


class RangeMinimum:
    """Minima of ranges of an array in constant time, from those of all ranges of a power of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << len(self.levels) - 1 <= len(x):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of x[low:high] for each pair; every range holds something."""
        power = np.log2(high - low).astype(np.int64)
        out = np.zeros(len(low), np.int32)
        for p, level in enumerate(self.levels):
            at = np.flatnonzero(power == p)
            if len(at):
                out[at] = np.minimum(level[low[at]], level[high[at] - (1 << p)])
        return out


def _nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, depth) of the inner nodes of the tree of strings in order whose neighbours' common prefixes are lcp; -1 parts trees."""
    n, found, stack = len(lcp), [], []
    for i, x in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][1] >= x:
            first, depth = stack.pop()
            if depth > x:
                found.append((first, i, depth))
        if x >= 0:
            stack.append((first, x))
    assert not stack and n >= 0
    return tuple(np.array([f[j] for f in found], np.int64) for j in range(3))


def repeated(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, groups: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, ...]:
    """(text, length, begin, end): bytes of texts within windows around their anchors that another text of their group has too.

    Texts lie in data between offsets, each with an anchor at its place; groups ascends. Spans of a text and length are apart.
    """
    sizes = np.diff(offsets)
    right, left = _matrix(data, offsets[:-1] + places, sizes - places, 1), _matrix(data, offsets[:-1] + places - 1, places, -1)
    r_order, l_order = deep_shallow(right, sizes - places, groups), deep_shallow(left, places, groups)
    r_lcp, l_lcp = neighbours(right, sizes - places, groups, r_order), neighbours(left, places, groups, l_order)
    n, none = len(places), tuple(np.zeros(0, np.int64) for _ in range(4))
    most = np.zeros((2, n), np.int64)
    for row, order, lcp in ((most[0], r_order, r_lcp), (most[1], l_order, l_lcp)):
        row[order] = np.maximum(np.concatenate([[-1], lcp]), np.concatenate([lcp, [-1]]))
    wide = most.sum(axis=0) >= min(lengths)  # others reach no window with any
    at = np.flatnonzero(wide[l_order])
    if len(at) < 2:
        return none
    rank = np.empty(n, np.int64)
    rank[r_order] = np.arange(n)
    r_least, members = RangeMinimum(r_lcp), l_order[at]
    first, last, depth = _nodes(RangeMinimum(l_lcp)(at[:-1], at[1:]))
    if not len(first):
        return none
    many, out, room = last - first + 1, [none], ENTRIES
    edges = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + ENTRIES, ENTRIES))
    for a, b in zip(edges[:-1].tolist(), [*edges[1:-1].tolist(), len(many)], strict=True):
        if a == b:
            continue
        m = many[a:b]
        node = np.repeat(np.arange(a, b), m)
        text = members[first[node] + np.arange(len(node)) - np.repeat(np.cumsum(m) - m, m)]
        order = np.lexsort((rank[text], node))
        node, text = node[order], text[order]
        same = np.flatnonzero(node[1:] == node[:-1])
        reach = r_least(rank[text[same]], rank[text[same + 1]])
        best = np.zeros(len(text), np.int64)
        best[same] = reach
        best[same + 1] = np.maximum(best[same + 1], reach)
        for length in lengths:
            # A window with `before` bytes left of the anchor: length - best <= before <= depth.
            hit = length - best <= depth[node]
            t, d = text[hit], depth[node][hit]
            out.append((t, np.full(len(t), length), places[t] - d, places[t] - np.maximum(length - best[hit], 0) + length))
        # A text lies in as many nodes as its tree is deep; what they say of it is united on the way.
        if sum(len(x[0]) for x in out) > room:
            out = [_united(out, lengths)]
            room = max(ENTRIES, 2 * len(out[0][0]))
    return _united(out, lengths)


def _united(spans: list[tuple[np.ndarray, ...]], lengths: Sequence[int]) -> tuple[np.ndarray, ...]:
    """(text, length, begin, end): the maximal spans of each text and length."""
    text, length, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    owner, begin, end = merged(text * len(lengths) + np.searchsorted(lengths, length), begin, end)
    return owner // len(lengths), np.asarray(lengths)[owner % len(lengths)], begin, end


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal spans of each owner."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    far = int(end.max()) + 1  # owners one behind the other
    rank = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
    before = np.concatenate([[-1], np.maximum.accumulate(end + rank * far)[:-1]])
    new = np.flatnonzero(begin + rank * far > before)
    return owner[new], begin[new], np.maximum.reduceat(end, new)


def _sorted_groups(lengths: Sequence[int]):
    """Rows of SORTED, by (one, two): a row with all spans of each single one that has any."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        one, two = get_from(rows, "one"), get_from(rows, "two")
        group = np.cumsum(np.concatenate([[False], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        rows, group = rows.take(pa.array(several)), group[several]
        text = length = begin = end = np.zeros(0, np.int64)
        if len(several):
            data, offsets = bytes_of(rows.column("text"))
            text, length, begin, end = repeated(data, offsets, get_from(rows, "place").astype(np.int64), group, lengths)  # texts ascend
            single = get_from(rows, "single")[text]
            text, length, begin, end = text[single], length[single], begin[single], end[single]
            shift = get_from(rows, "begin")[text]
            begin, end = begin + shift, end + shift
        owner, first = np.unique(text, return_index=True)
        flat = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(length, pa.int32())], names=["begin", "end", "length"])
        spans = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(text)], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(get_from(rows, c)[owner], pa.int64()) for c in ("rid", "sid")] + [spans], names=["rid", "sid", "spans"])

    def get_from(rows: pa.Table, column: str) -> np.ndarray:
        return rows.column(column).combine_chunks().to_numpy(zero_copy_only=False)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            one, two = get_from(rows, "one"), get_from(rows, "two")
            same = np.flatnonzero((one != one[-1]) | (two != two[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0  # the last group may go on
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                count = rows.num_rows - cut
        if count:
            yield settle(pa.Table.from_batches(held))

    return found


def _cut_texts():
    """Rows (rid, sid, text, list of anchors): the text around each anchor, as rows of SORTED, and whether its group is large."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            data, offsets = bytes_of(batch.column(2))
            lists = batch.column(3)
            flat, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            get = lambda c, f=flat: f.field(c).to_numpy(zero_copy_only=False)
            at = get("at")
            begin, place, size = at >> 32, (at >> 16 & 0xFFFF).astype(np.int32), at & 0xFFFF
            low = offsets[owner] + begin
            for i in range(0, len(owner), 4096):
                cut = slice(i, i + 4096)
                texts = pa.array([data[a : a + n].tobytes() for a, n in zip(low[cut].tolist(), size[cut].tolist(), strict=True)], pa.binary())
                mine = pa.array(owner[cut])
                columns = [pa.array(get("shared")[cut]), pa.array(np.zeros(len(texts), np.int64)), batch.column(0).take(mine), batch.column(1).take(mine), pa.array(begin[cut]), pa.array(place[cut]), pa.array(get("single")[cut]), texts, pa.array(get("large")[cut])]
                yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "rid", "sid", "begin", "place", "single", "text", "large"])

    return found


def _dealt_again(lengths: Sequence[int]):
    """Rows of SORTED with before, after (bytes left of the anchor and from it on that the group shares): the same in smaller groups.

    A partner for a window shares all of it. Of what the group doesn't share yet, it shares the first half to the right or
    the other half to the left; the string goes to a group of either. Where the group shares a whole window of a length
    that window is repeated: a row with that length in `whole` says so, and the next length is what is halved on.
    """

    def key(row: dict, before: int, after: int) -> dict:
        shared = row["text"][row["place"] - before : row["place"] + after]
        digest = hashlib.blake2b(b"%d %d %d %d " % (row["one"], row["two"], before, after) + shared, digest_size=16).digest()
        return row | {"one": int.from_bytes(digest[:8], "little", signed=True), "two": int.from_bytes(digest[8:], "little", signed=True), "before": before, "after": after, "whole": 0}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            out = []
            for row in batch.to_pylist():
                before, after, most = row["before"], row["after"], len(row["text"])
                out += [row | {"whole": x} for x in lengths if row["single"] and x <= before + after]
                # A length that was whole a round ago is said again; spans are a set.
                need = next((x for x in lengths if before + after < x <= most), None)
                if need:
                    half = -(-(need - before - after) // 2)
                    out += [key(row, b, a) for b, a in ((before, after + half), (before + half, after)) if b <= row["place"] and a <= most - row["place"]]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return found


# -- the operator -----------------------------------------------------------------------------------------------------


def _span(begin: Column, end: Column, length: Column) -> Column:
    return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"), length.cast("int").alias("length"))


def _small_groups(rows: DataFrame, lengths: Sequence[int], k: int) -> tuple[DataFrame, DataFrame]:
    """(rows of SORTED in groups that a task can sort, spans that are settled on the way) of the rows of large groups."""
    pending, small, settled = rows.withColumns({"before": F.lit(0), "after": F.lit(k), "whole": F.lit(0)}), [], []
    while True:
        dealt = written(pending.mapInArrow(_dealt_again(lengths), f"{SORTED}, before int, after int, whole int"), "dealt-again")
        at = F.col("begin") + F.col("place")
        settled.append(dealt.where("whole > 0").select("rid", "sid", F.array(_span(at - F.col("before"), at + F.col("after"), F.col("whole"))).alias("spans")))
        groups = dealt.where("whole = 0")
        sizes = written(groups.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
        small.append(groups.join(sizes.where(f"n <= {GROUP}").select("one", "two"), ["one", "two"], "left_semi").drop("before", "after", "whole"))
        if sizes.where(f"n > {GROUP}").isEmpty():
            return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, settled)
        pending = groups.join(sizes.where(f"n > {GROUP}").select("one", "two"), ["one", "two"], "left_semi").select(*dealt.columns)


def repeated_spans(docs: DataFrame, lengths: Sequence[int], k: int = 32) -> DataFrame:
    """(rid, sid, spans) of the rows of docs (doc_id, text; see common.row_keys), a row an anchor or more: (begin, end, length) of bytes of windows of a length that start elsewhere too."""
    bounded_batches(docs.sparkSession)
    lengths = sorted(set(lengths))
    k = min(k, lengths[0])
    keyed = docs.select(*row_keys(), F.col("text"))
    found = written(keyed.mapInArrow(_anchor_rows(lengths, k), "rid long, sid long, at long, shared long, around long"), "anchors")
    # Only anchors whose first bytes occur again can be repeated.
    again = found.groupBy("shared").agg(F.count("*").alias("n")).where("n > 1").select("shared")
    known = written(found.join(again, "shared", "left_semi"), "known-anchors")
    # Anchors with the same surroundings are one class: the hash of the shared bytes and a cryptographic one of all of
    # them agree. Of two or more, every window is repeated; in the sort such a class is one string.
    classes = known.groupBy("shared", "around").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("rid", "sid", "at")])
    strings_of = classes.groupBy("shared").agg(F.count("*").alias("strings"))
    surroundings = written(classes.join(strings_of, "shared"), "surroundings")
    several = surroundings.where("strings > 1").withColumns({"single": F.col("n") == 1, "large": F.col("strings") > GROUP})
    texts = keyed.groupBy("rid", "sid").agg(F.first("text").alias("text"))

    lists = several.groupBy("rid", "sid").agg(F.collect_list(F.struct("shared", "at", "single", "large")).alias("list"))
    cut = texts.join(lists, ["rid", "sid"]).select("rid", "sid", "text", "list").mapInArrow(_cut_texts(), f"{SORTED}, large boolean")
    strings, spans = cut.drop("large"), []
    if (surroundings.agg(F.max("strings")).first()[0] or 0) > GROUP:
        cut = written(cut, "strings")  # once for both: texts are shuffled for it
        small, settled = _small_groups(cut.where("large").drop("large"), lengths, k)
        strings, spans = cut.where("not large").drop("large").unionByName(small), [settled]
    dealt = strings.repartition("one", "two").sortWithinPartitions("one", "two")
    spans.append(dealt.mapInArrow(_sorted_groups(lengths), SPANS))
    twice = surroundings.where("n > 1").select("shared", "around")
    begin, size = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFF)
    whole = known.join(twice, ["shared", "around"], "left_semi").select("rid", "sid", begin.alias("begin"), (begin + size).alias("end"))
    each = F.filter(F.array(*[_span(F.col("begin"), F.col("end"), F.lit(x)) for x in lengths]), lambda x: x["end"] - x["begin"] >= x["length"])
    return reduce(DataFrame.unionByName, spans, whole.where(f"end - begin >= {lengths[0]}").select("rid", "sid", each.alias("spans")))


def covered(docs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(rid, sid, spans): for each row with repeated bytes, the sorted list of its repeated spans (begin, end, length), bytes of the UTF-8 text."""
    spans = repeated_spans(docs, lengths)
    return spans.groupBy("rid", "sid").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))


def _runs(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs that the spans of one length cover."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if s["length"] == length:
            if out and s["begin"] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
            else:
                out.append((s["begin"], s["end"]))
    return out


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal(docs: DataFrame, length: int = 400, passage: int = 256, passage_words: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes of each row of docs (doc_id, text).

    A null text has no bytes; texts of fewer than length bytes lose nothing, and no match crosses texts. Rows that repeat
    both doc_id and text are two texts, so each is found in the other. Rows come out as often as they come in.
    n_passages and passage_bytes tell, without removing them, of the maximal runs of more than passage_words words that
    repeated strings of `passage` bytes cover: passages may be shorter than what is removed.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, listed in zip(*batch.columns, strict=True):
                data, spans = (text.as_py() or "").encode(), listed.as_py()
                runs = _runs(spans, length)
                passages = [(a, b) for a, b in _runs(spans, passage) if len(data[a:b].split()) > passage_words]
                rows.append((doc.as_py(), len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_without(data, runs)).hexdigest(), len(passages), sum(b - a for a, b in passages)))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "kept_sha256" else pa.int64()) for c, name in zip(columns, names, strict=True)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.select("*", *row_keys()).join(covered(docs, [length, passage]), ["rid", "sid"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names))


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs, all columns, with the repeated bytes cut out of text; bytes of a character that is cut in part go with it.

    A text that is cut away whole stays as an empty one; a null one stays null. n_chars, where there is one, is counted anew.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else _without(t.as_py().encode(), _runs(s.as_py(), length)).decode("utf-8", "ignore") for t, s in zip(batch.column(0).field("text"), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_doc", "_text"])

    names = docs.columns
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rid, sid = row_keys()
    rows = docs.select(rid.alias("_rid"), sid.alias("_sid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    joined = rows.join(covered(slim, [length]), (F.col("_rid") == F.col("rid")) & (F.col("_sid") == F.col("sid")), "left").select("_doc", "spans")
    new = joined.mapInArrow(cut, f"_doc {rows.schema['_doc'].dataType.simpleString()}, _text string")
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return new.select(*[(fresh[c] if fresh.get(c) is not None else F.col(f"_doc.`{c}`")).alias(c) for c in names])
