"""Labelled rows to learn from, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, y of about ``rows`` labelled documents (all, if there are no more) that aren't held out.

    The sample goes by a hash of doc_id, the same for every run; a document
    with several labels counts as its greatest, null labels as none.
    """
    y = labels.where(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = y.count()
    share = min(1.0, rows / max(n, 1))
    taken = y.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < share * 1_000_003)
    # as many rows as asked for: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
