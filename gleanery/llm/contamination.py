"""Finding benchmark items inside documents by size-partitioned MinHash containment.

An item's MinHash sketch is the least hashes of its shingles.  Plain MinHash
compares two sketches and misses a short item in a long document; here an
item's sketch is looked up among all shingles of the document.  Items are
partitioned by size; a sketch's length goes by its item's size, so that a
document that holds the wanted share of the shingles must hold one of the
sketch.  Each partition is probed by itself, with its own greatest hash and
least size.  Candidates are verified by exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .wordlists import let, shingle_hashes

#: Words of a shingle; per cent of an item's shingles that a document holds.
SHINGLE, PERCENT = 5, 80


def sketch_length(n: Column, percent: int) -> Column:
    """So many of n shingles that no set with ``percent`` of all lacks them all."""
    return (n - F.ceil(n * percent / F.lit(100.0)) + 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Pairs doc_id, item_id, n_item_shingles, n_shared of documents that hold ``percent`` of an item's distinct shingles or more.

    docs: doc_id, text; items: item_id, text; other columns are left out.  A-Z
    is folded.  Items without words are found nowhere, one of fewer than ``k``
    words is one shingle, which only a document of the same words has.  A null
    id stays a null id; rows that share ids are one (the most they share
    counts); no rows give none.
    """
    sized = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), k))).alias("shingles")).where(F.size("shingles") > 0)
    own = written(sized.select("item_id", "shingles", F.size("shingles").alias("n"), F.ceil(F.log2(F.size("shingles"))).cast("int").alias("size_class")), "items")
    sketches = own.select("item_id", "n", "size_class", F.explode(F.slice("shingles", F.lit(1), sketch_length(F.col("n"), percent))).alias("hash"))
    # the partitions: a document is looked up in a size class if it can hold an item of it, by hashes no greater than any of the class's sketches
    limits = sketches.groupBy("size_class").agg(F.max("hash").alias("most"), F.min("n").alias("least")).collect()  # one row for each power of two
    rows = docs.select("doc_id", shingle_hashes(F.col("text"), k).alias("all"))

    def low(a: Column, size_class: int, most: int, least: int) -> Column:
        own = F.transform(F.filter(a, lambda h: h <= most), lambda h: F.struct(F.lit(size_class).alias("size_class"), h.alias("hash")))
        return F.when(F.size(a) * 100 >= least * percent, own).otherwise(none)

    none = F.array().cast("array<struct<size_class:int,hash:bigint>>")
    probes = lambda a: F.flatten(F.array(none, *(low(a, *r) for r in limits)))
    probe = rows.select("doc_id", let(F.col("all"), probes).alias("low"), F.size("all").alias("size")).select("doc_id", "size", F.explode("low").alias("p"))
    hits = probe.select("doc_id", "size", "p.size_class", "p.hash").join(sketches, ["size_class", "hash"]).where(F.col("size") * 100 >= F.col("n") * percent)
    candidates = written(hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id")).alias("items")), "candidates")
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(candidates, F.col("id").eqNullSafe(F.col("doc_id")))
    pairs = wanted.select("doc_id", F.array_distinct(shingle_hashes(F.col("text"), k)).alias("all"), F.explode("items").alias("item"))
    shared = pairs.join(own.select("item_id", "shingles", "n"), F.col("item.item_id").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("all", "shingles")).cast("long").alias("n_shared"))
    found = shared.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)
    return found.groupBy("doc_id", "item_id").agg(F.max_by("n_item_shingles", "n_shared").alias("n_item_shingles"), F.max("n_shared").alias("n_shared"))
