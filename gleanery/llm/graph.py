"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node reachable from each node of links (a, b), itself included; linked nodes only.

    Alternates connecting each node's larger and smaller neighbours to the
    least one, until only stars are left; rounds grow with the logarithm of the
    longest chain.  Each round is a table in the shared folder.  Nulls and
    loops link nothing, repeated links count once.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v and a is not null and b is not null").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(tied.select("e.u", "e.v").where("u <> v").distinct(), "links")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
