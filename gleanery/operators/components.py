"""Connected components of few links, by least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def components(pairs: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes in pairs a, b; each round is a table in the shared folder."""
    both = written(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        # a node takes the least label among its neighbours', then its label's own label
        least = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = state.join(least, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        hop = state.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(new.join(hop, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old"))
        state = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return state
