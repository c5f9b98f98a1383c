"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquela.llm import decontam, htmltext, langid, packing, pii, simhash, suffix, tokenfile, topk, warc
from loquela.llm._shared import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    docs = e.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    found = topk.top_k(docs.filter("vec_id % 50 = 0"), docs, 5)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op2_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    items = written(packing.pieces(docs, _vocabulary("byte_bpe_50k.json")))
    found = packing.pack(items)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op10_rangecoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = tokenfile.round_trip(docs, shared_dir(spark), _vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"), shared_dir(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS b FROM pages
), bits AS (
  SELECT html, any_value(b) AS b, max(page_id) AS first_id FROM p GROUP BY html
), hexed AS (
  SELECT html, octet_length(b) AS n, first_id,
    list_aggregate(list_transform(range(0, 20), lambda i:
      lpad(bin(CAST('0x' || substr(sha1(b), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER)), 8, '0')), 'string_agg', '') AS s
  FROM bits
), coded AS (
  SELECT html, n, first_id, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j:
      CAST(substr(s, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS d
  FROM hexed
)
SELECT p.page_id, CAST(c.n AS BIGINT) AS payload_bytes, c.d AS payload_digest,
  CASE WHEN p.page_id = c.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = c.first_id THEN NULL ELSE c.first_id END AS refers_to
FROM p JOIN coded c ON p.html = c.html"""


@_query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


#: For pages as the tables have them: one article, bold the only inline element, two character references.
ORACLES["op9_html"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1) AS x FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '(?i)</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""


#: The pseudonyms' key of the registered queries; a real run passes its own secret.
PII_KEY = b"not a secret: registered queries only"


@_query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.withColumn("n_found", F.size("pii_spans"))


@_query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "declared", "kept")


@_query
def pages_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages: declared markup language, address suffix and host."""
    found = langid.identify_pages(_table(spark, sf_dir, "pages"))
    return found.select(F.col("doc_id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "declared", "kept")


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Strings of 100 bytes by their hashes, in blocks of 200 starts; the first of equal ones stays.
ORACLES["op8_suffix"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
c AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, 2 * 299) AS y FROM (SELECT doc_id, n, x, unnest(range(0, n - 99, 200)) AS o FROM d WHERE n >= 100)),
w AS (SELECT doc_id, o + p AS p, hash(substr(y, 2 * p - 1, 200)) AS w FROM (SELECT doc_id, o, y, unnest(range(1, least(200, n - 99 - o) + 1)) AS p FROM c)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s),
t AS (SELECT k.doc_id, sum(b - a + 1) AS removed, count(*) AS spans, string_agg(substr(x, 2 * prev + 1, 2 * (a - 1 - prev)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""
