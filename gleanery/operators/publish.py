"""Writing issues and lists: inserts, upserts, trims, cascades, as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per, top


def insert_if_absent(stored: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """The new rows that are written: keys not stored yet, the first of each."""
    return first_per(new.join(stored.select(key), key, "left_anti"), [key], order)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after the new rows replaced those of their keys."""
    return stored.join(new, keys, "left_anti").unionByName(new)


def upsert_columns(stored: DataFrame, new: DataFrame, key: str, machine: list[str]) -> DataFrame:
    """Replace the machine's columns only; what readers wrote stays."""
    right = new.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in machine), F.lit(True).alias("_is_new"))
    both = stored.join(right, key, "full_outer")
    return both.select(*(F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in machine else F.col(c) for c in stored.columns))


def replace_list(stored: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """The snapshot after the new lists took their scopes whole, shorter ones too; a scope without new rows keeps its old list."""
    return stored.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def must_read(items: DataFrame, issue: str, order: list, n: int = 3, key: str = "id") -> DataFrame:
    """items with must_read: among the n first of their issue. Only n rows an issue are ranked and joined back, by issue and key."""
    best = top(items, [issue], order, n, "_place").select(issue, key, F.lit(True).alias("must_read"))
    return items.join(best, [issue, key], "left").withColumn("must_read", F.coalesce("must_read", F.lit(False))).select(*items.columns, "must_read")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def mirror_queue(items: DataFrame, repos: DataFrame) -> DataFrame:
    """Links to mirror: items of 85 or more, must-reads and those of the daily list, and the week's repos, which win over items."""
    picked = items.where((F.col("score") >= 85) | F.col("must_read") | F.col("in_daily_top")).select("url", F.lit("item").alias("kind"), "id", F.lit(1).alias("_p"))
    return first_per(picked.unionByName(repos.select("url", F.lit("repo").alias("kind"), "id", F.lit(0).alias("_p"))), ["url"], ["_p", "id"]).drop("_p")


def unused(stored: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Stored paths that nothing refers to."""
    return stored.join(used, key, "left_anti")


def valid(checks: dict[str, Column]) -> Column:
    """The first check that fails, or null."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))
