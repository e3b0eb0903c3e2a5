"""The training-data pipeline: quality filter, near-dedup, decontamination, secret scan, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as
Parquet and reread as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bpe_fst, near_copies, positional, quality_cnn, queries, secrets, simhash
from wardline.llm.common import written
from wardline.shipping import shipped

#: Rows and columns of the documents table.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good; it learns from the labelled ones that aren't held out."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs.select(*COLUMNS), model, score_col="quality_score").where(f"quality_score >= {queries.GOOD}").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near_copies.near_dedup(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words that a benchmark item has too (or a whole shorter item)."""
    found = positional.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return simhash.without(docs.select(*COLUMNS), written(found, "contaminated"), "doc_id")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark and the characters counted anew."""
    return secrets.redact(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded_sha256."""
    return bpe_fst.encode_documents(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern(), keep=("lang", "source"))


STAGES = [
    ("quality_filter", shipped(quality_filter)),
    ("near_dedup", shipped(near_dedup)),
    ("decontaminate", shipped(decontaminate)),
    ("redact_secrets", shipped(redact_secrets)),
    ("tokenise", shipped(tokenise)),
]

#: SQL can't express the classifier or the transducer; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
