"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows
as Parquet in the shared folder and reads them again as the next one's docs.

Defined results: an empty table goes through as one; null texts are empty, so the quality rule rejects them; null doc_ids, langs and
sources are values of their own, and rows with a null or repeated doc_id are told apart by all their columns; of rows that
are equal in all columns one stays; ties go by the smaller doc_id, then by the hashes of text and row; other columns pass through to the
last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import common, mixing, packing, quality_rules, secret_scan, simhash

#: Rows in an Arrow batch: documents are kilobytes each, and a worker holds a batch and what it makes of it.
BATCH_ROWS = "500"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's thresholds reject go."""
    _small_batches(spark)
    return quality_rules.filter_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (a likeness of 0.8 and more by five words) stays, that with the smallest doc_id."""
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [REDACTED]; every document stays."""
    _small_batches(spark)
    return secret_scan.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, shortened or left out, so that sources come to their target weights."""
    _small_batches(spark)
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in training sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Thresholds from sketches, fingerprints, keyed permutations and tokenizer ids have no SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with common.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        before, docs = path, spark.read.parquet(path)
    return docs
