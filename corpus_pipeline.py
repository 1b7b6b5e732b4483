"""The corpus pipeline: each stage takes what the one before it kept, is written as Parquet, and is read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables, and extra
columns of any name, which it passes on; what becomes of such rows stands at each stage.
"""

from __future__ import annotations

import uuid

from corpusloom.llm import bpe, contamination, neardup, pii, quality
from corpusloom.llm.common import scratch, table
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the risk-controlled cutoffs reject. Null and empty texts have no words and go; rows are judged each for itself; a null id or language has no labels, so the base rules decide."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. A text without words is linked with nothing and stays; rows that share an id and a text are one group, of which one row stays; rows without an id stay."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates. A null text is clean and stays, an empty benchmark leaves all, and repeated rows go or stay together."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind. Null texts stay null, and no row is dropped; repeated rows are redacted alike."""
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts, null ones as empty, and gives a row for each row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_inside."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch(spark)}/loom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs


#: SQL can't express the last stage (byte-pair merges); tests hold run() against a brute-force version.
ORACLE_SQL = None
