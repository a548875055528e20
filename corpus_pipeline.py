"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all that the one before kept, written as Parquet and read
again; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import contamination, jaccard, packing, quality, storage, substring

#: No SQL expresses the robust estimates of the first stage or the last one's tokens; tests hold each stage against a brute-force version.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among ids; a null id is an id like others. The ids are a written table, so a join goes by their size."""
    gone = storage.written(ids.select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or are outliers of their language and source go."""
    return without(docs, quality.quality_rules(docs).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect the least doc_id stays; one without words is in no group and stays."""
    return without(docs, jaccard.jaccard_classes(docs).where("component_id <> doc_id or (component_id is null and doc_id is not null)"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier too are cut; a text without cuts stays as it is, one of which nothing is left goes."""
    rows = substring.substring_dedup(docs, carry=["lang", "source", "n_chars"])
    cut = F.col("n_removed") > 0
    n_chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.where(~cut | (F.col("text") != "")).withColumn("n_chars", n_chars).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, contamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = storage.written(docs, f"stage{i}")
    return docs
