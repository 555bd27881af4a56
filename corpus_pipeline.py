"""The corpus pipeline: stages that each take the documents their predecessor kept.

All stages but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, near_copies, ordinal, packing, secrets
from millrace.llm.common import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal classifier, fitted on the labels, selects."""
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of copies and near copies."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0)
    bad = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"]) == F.col("bad_text"))
    return docs.join(bad.hint("shuffle_hash"), same, "left_anti")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; keeps all documents."""
    found, _ = secrets.scan(docs)
    clean = secrets.redact(docs, found)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.best_fit(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what a stage keeps is stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
