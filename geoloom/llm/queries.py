"""The queries of the corpus operators, over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, fim, langid, minhash, mixing, packing, pivotperm, quality, sharding, suffixes, voronoi, warc
from .common import scratch, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts hold control strings, rendered and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.render(chat.fold(chat.log_of_turns(rows))))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.OrdinalModel | None:
    labels = table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", quality.grade_of_labels(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.train(table(spark, sf_dir, "documents"), graded, top=2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document (0 poor, 1 toxic, 2 good) and the probability of the best one."""
    return quality.grade(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), at_least=2)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, revisits resolved, and the archives read back."""
    path = scratch(spark, "warc")
    warc.write_archives(warc.resolve(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from each document."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated string of 400 bytes covers."""
    return suffixes.removal(table(spark, sf_dir, "documents"), length=400)


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows for every fiftieth vector."""
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.93 or more."""
    return pivotperm.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles are 85 % alike."""
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, words_per_shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lambda key: F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    found = langid.identify(docs, langid.train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards of one weight by rendezvous hashing, and where they'd lie with one more."""
    return sharding.layout(table(spark, sf_dir, "documents"), weights=(1.0,) * 16)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for fill-in-the-middle, and put together again."""
    made = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and the 200 terms that tell it from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_quality_classifier, op3_warc_revisits, op4_packing, op5_source_mixing, op6_suffix_dedup, op7_voronoi_topk, op8_pivot_permutation, op9_minhash_near_dedup, op10_language_id, op11_sharding, op12_fill_in_middle, op13_source_divergence)
}

ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS er,
    regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS et FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST]' || er || '[/INST]' || et || '</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op7_voronoi_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_source_mixing": r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
b AS (
  SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM a),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
    sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM b),
d AS (SELECT *, cap * w_left < (total - c_before) * w AS stops FROM c),
e AS (
  SELECT *, CAST(total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS DOUBLE) AS rest,
    CAST(sum(CASE WHEN NOT stops THEN w END) OVER () AS DOUBLE) AS rest_w FROM d),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE rest * w / rest_w END AS target FROM e),
j AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':17'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM j""",
    "op11_sharding": r"""
WITH c AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([CAST(n AS BIGINT)], list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS text_crc32
  FROM documents, c),
e AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 4096 AS run FROM d),
f AS (
  SELECT *, list_transform(range(0, 17), lambda s: 1 / -ln((CAST('0x' || substr(md5(k || ':' || s || ':11'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS claims,
    CAST('0x' || substr(md5(k || ':' || size || ':' || text_crc32 || ':' || run), 1, 13) AS BIGINT) AS place FROM e),
g AS (SELECT *, CAST(list_position(claims[1:16], list_max(claims[1:16])) - 1 AS INTEGER) AS shard FROM f)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32, run) - 1 AS slot,
  CAST(CASE WHEN claims[17] > list_max(claims[1:16]) THEN 16 ELSE shard END AS INTEGER) AS grown_shard
FROM g""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
h AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(draw, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(draw, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(draw, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(draw, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, i, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d),
l AS (SELECT c.lang, c.term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY c.lang) AS total FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (l.n + 1) // (l.total + v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN l ON l.lang = k.lang AND l.term = k.term
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200""",
}
