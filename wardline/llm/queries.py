"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_fst, html_text, positional, quality_cnn, repeats, secrets, simhash, token_files, topk_search, warc

#: A text is good from this score on.
GOOD = 0.7


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20, scale=64)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words_per_shingle=3, budget=2)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_cnn.Model:
    return quality_cnn.fit(docs, labels, lambda i: ~held_out(i))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage of 50 words or more that goes: documents without one have no row."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words", "first_doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_simhash_near_dedup, op3_quality_classifier, op4_token_files, op5_substring_dedup, op6_warc, op7_bpe, op8_decontamination, op9_secret_scan, op10_html_text)}

SQL = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN g.top IS NULL OR g.top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top <> d.page_id THEN g.top END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h""",
    "op8_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(l)) AS k, array_to_string(l[p : p + least(10, len(l)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(l) - 9) + 1)) AS p FROM i WHERE len(l) > 0)),
dw AS (
  SELECT doc_id, k, p, array_to_string(l[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM iw) WHERE len(l) >= k)),
m AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.l) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id""",
}
