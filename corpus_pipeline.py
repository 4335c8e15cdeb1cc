"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. ``docs`` has the columns of ``documents``, and so has what all but the
last return. A document is known by its doc_id: rows that repeat one share its
fate, and rows without one are never taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, decontaminate, near_dup, quality, secret_scan
from offerloom.llm.common import drop_ids, materialize


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what the base rules or the certified cutoffs reject."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_ids(docs, materialize(judged.filter("NOT kept").select("doc_id"), "rejected"), "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group."""
    grouped = near_dup.near_duplicates(docs, k=5, percent=80)
    return drop_ids(docs, materialize(grouped.filter("NOT kept").select("doc_id"), "copies"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that contain a benchmark item."""
    found = decontaminate.contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, threshold=0.8)
    return drop_ids(docs, materialize(found.select("doc_id"), "leaks"), "doc_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a marker in place of each secret; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document; the digest is
    that of the text which the ids decode to."""
    return bpe.encode(docs, tokenizer_file(), digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Neither MinHash with its components nor BPE can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
