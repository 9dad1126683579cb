"""The corpus pipeline: documents, stage by stage, into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents. Stages are
written as Parquet in the shared folder, so a lost executor never reaches back
over a stage. Nulls, empty and long texts, repeated rows, empty tables and extra
columns have the results that the operators define; further columns of documents
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import minhash, packing, quality_ranker, source_mix, suffix_dedup
from mensura.llm._store import table
from mensura.llm.labelled import remainder


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` for the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_ranker.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return quality_ranker.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that start earlier in the corpus."""
    return _measured(suffix_dedup.deduplicated(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that sources meet their target weights."""
    return _measured(source_mix.mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packed),
]
# Learned scores, MinHash and byte-pair tokens have no SQL form; tests compare stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
