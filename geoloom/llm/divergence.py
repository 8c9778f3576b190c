"""How far the sources of a language differ in their terms, priced from joint tables of count levels.

A group is a (lang, source). What two groups say of a term depends only on how often each has it, so their joint table,
the number of terms for each pair of count levels, prices the pair. With a row for each kept term and an indicator column
for each (group, level), all joint tables of a language are the product of the transposed matrix with the matrix. Terms
are dealt to blocks; a block multiplies its own rows, tile of columns by tile of columns, prices the tables that come out
and sends on one sum for each pair of groups. Entries are whole numbers below 2**24, which the product holds exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

SCALE = 1_000_000_000
#: Terms of a block and columns of a tile: a block's matrix has TERMS rows and TERMS columns a group at most.
TERMS, TILE = 256, 2048
#: Different (group, term) counts that a task holds before it sends them on.
HELD = 200_000
#: Every byte to what stands for it in a term: A-Z lower-cased; letters and bytes of other characters stay, others part terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), over whole texts; nulls are ''. A group without terms has a row of term null.

    Counts are gathered in the tasks that read the texts (HELD at most), so that a frequent term or source is few rows
    before the shuffle.
    """
    bounded_batches(docs.sparkSession)
    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, within = defaultdict(Counter), defaultdict(Counter)

        def sent():
            for (lang, source), own in times.items():
                docs_of, terms = within[lang, source], list(own)
                columns = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*own.values(), 0]), pa.array([*(docs_of[t] for t in terms), 0])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            times.clear()
            within.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().encode().translate(_TERM_BYTES).split()
                own = times[lang, source]
                held -= len(own)
                own.update(words)
                held += len(own)
                within[lang, source].update(set(words))
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    found = filled.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), in whole numbers of 38 digits."""
    return F.lit(1).cast("long") + F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(26,0)")), (total + kept).cast("decimal(26,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q): no more than 10**18, which a long holds."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), q)


def _priced_pairs(terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """source, item, value: the priced joint tables of a block's terms for all pairs of groups.

    terms: term, source, n, p of the block's entries; groups: source, p0 (the price of no occurrence) of all groups.
    """
    names = sorted(groups["source"])
    place = {s: i for i, s in enumerate(names)}
    zero = np.zeros(len(names), np.int64)
    zero[groups["source"].map(place)] = groups["p0"]
    row, _ = pd.factorize(terms["term"])
    height = int(row.max()) + 1
    level, cost = np.zeros((height, len(names)), np.int64), np.tile(zero, (height, 1))
    at = row, terms["source"].map(place).to_numpy()
    level[at], cost[at] = terms["n"], terms["p"]
    # Columns: the levels that the block has in each group, group after group.
    of, prices, column = [], [], np.empty_like(level)
    for g in range(len(names)):
        _, first, number = np.unique(level[:, g], return_index=True, return_inverse=True)
        column[:, g] = number + len(of)
        of += [g] * len(first)
        prices += cost[first, g].tolist()
    of, prices = np.array(of), np.array(prices, np.int64)
    edges = np.searchsorted(of, np.arange(len(names) + 1))
    tiles, begin = [], 0  # whole groups, of TILE columns or a single group
    for g in range(len(names)):
        if g + 1 == len(names) or edges[g + 2] - edges[begin] > TILE:
            tiles.append((begin, g + 1))
            begin = g + 1

    def indicator(tile: tuple[int, int]) -> np.ndarray:
        x = np.zeros((height, edges[tile[1]] - edges[tile[0]]), np.float32)
        for g in range(*tile):
            x[np.arange(height), column[:, g] - edges[tile[0]]] = 1
        return x

    value = np.zeros((len(names), len(names)), np.int64)
    for k, left in enumerate(tiles):
        x = indicator(left)
        for right in tiles[k:]:
            joint = x.T @ (x if right == left else indicator(right))
            i, j = np.nonzero(joint)
            times, i, j = joint[i, j].astype(np.int64), i + edges[left[0]], j + edges[right[0]]
            p, q = prices[i], prices[j]
            gap = (p - q) * (p - q)
            np.add.at(value, (of[i], of[j]), gap // q * times)
            if right != left:
                np.add.at(value, (of[j], of[i]), gap // p * times)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"source": np.array(names, object)[a], "item": np.array(names, object)[b], "value": value[a, b]})


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to the other sources of its language (pair) and the terms by which it stands out from the language (term).

    A language keeps the terms in least_docs of its documents or more. A group prices each of them by its share there,
    with one added to every count (price); value is distance summed over all kept terms for part pair, and of a single
    term for part term, which has the group's own terms of a price above the language's, the first top ranks. Nulls of
    text, lang and source are ''; every row is a document, also a repeated one; groups without a kept term take part with
    the price of no occurrence; a language without a kept term gives pairs of value 0; other columns are left alone; an
    empty table gives no row. The pairs of a language's sources are the result itself, so their number is taken as bounded.
    """
    counts = written(term_counts(docs), "term-counts")
    groups = counts.select("lang", "source").distinct()
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("all_n")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = written(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))  # a row for each language
    entries = written(counts.where("term is not null").join(kept, ["lang", "term"]), "kept-counts").drop("docs")
    totals = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    totals = written(totals.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total")]), "group-totals")
    priced = entries.join(totals, ["lang", "source"]).withColumns({"p": price(F.col("n"), F.col("total"), F.col("v")), "q": price(F.col("all_n"), F.col("all_total"), F.col("v"))})

    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TERMS).cast("long"))
    dealt = priced.select("lang", block.alias("block"), "term", "source", "n", "p")
    everywhere = totals.where("v > 0").select("lang", "source", price(F.lit(0), F.col("total"), F.col("v")).alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("v") / TERMS).cast("long") - 1)).alias("block"))

    def solve(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        if terms.empty:  # a block that no term fell into
            return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}).astype({"value": "int64"})
        found = _priced_pairs(terms, groups)
        found.insert(0, "lang", key[0])
        return found

    parts = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInPandas(solve, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    # Ranks up to top: Spark ranks within each task first and sends on no more than top rows a group and task.
    return pairs.withColumn("rank", place).unionByName(own.withColumn("rank", place).where(F.col("rank") <= top))
