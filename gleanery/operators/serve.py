"""What readers are shown: archive, repositories, radar, favourites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def archive(issues: DataFrame, items: DataFrame) -> DataFrame:
    """Per issue: item count, minutes in all, and the title of the greatest score (ties: least id)."""
    agg = items.groupBy("issue_id").agg(F.count("*").alias("items"), F.sum("read_minutes").alias("minutes"), F.min_by("title", F.struct(-F.col("score"), F.col("id"))).alias("top_title"))
    return issues.join(agg, "issue_id", "left").select("issue_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("minutes", F.lit(0)).alias("minutes"), "top_title")


def repo_history(ranks: DataFrame) -> DataFrame:
    """Per repository (any case): its latest row, first and last week, number of weeks, best rank; one aggregate."""
    key = F.lower("repo").alias("repo_key")
    last = F.max_by(F.struct("repo", "stars"), F.struct("issue_id", -F.col("rank")))
    found = ranks.groupBy(key).agg(last.alias("l"), F.min("issue_id").alias("first_week"), F.max("issue_id").alias("last_week"), F.count_distinct("issue_id").alias("week_count"), F.min("rank").alias("best_rank"))
    return found.select("repo_key", "l.*", "first_week", "last_week", "week_count", "best_rank")


def with_rating(rows: DataFrame, ratings: DataFrame, key: str, kind: str) -> DataFrame:
    """rows with the reader's rating of them and whether it is down."""
    own = ratings.where(F.col("target_kind") == kind).select(F.col("target_id").alias(key), F.col("value").alias("rating"))
    return rows.join(own, key, "left").withColumn("disliked", F.coalesce(F.col("rating") == -1, F.lit(False)))


def embed(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """parents with an array of their children in order; none is an empty array."""
    cols = [*order, *(c for c in children.columns if c not in order and c != key)]
    folded = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    return parents.join(folded, key, "left").withColumn(name, F.coalesce(name, F.array().cast(folded.schema[name].dataType)))


def favourites(hearts: DataFrame, items: DataFrame, posts: DataFrame, repos: DataFrame) -> DataFrame:
    """Hearts joined with what they are given to; a repository no list has any more is shown by its id, other orphans aren't shown."""
    found = [hearts.where(F.col("kind") == k).join(t.select(F.col("id").alias("target_id"), "title"), "target_id", how).withColumn("title", F.coalesce("title", "target_id")) for k, t, how in (("item", items, "inner"), ("post", posts, "inner"), ("repo", repos, "left"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def unread_first(must_read: Column, read: Column) -> Column:
    """Sort key: must-reads, then others; unread ones first in each."""
    return (F.when(must_read, 0).otherwise(2) + F.when(F.coalesce(read, F.lit(False)), 1).otherwise(0)).cast("long")


def override(mine: Column, made: Column) -> Column:
    """What a reader wrote wins over what was made, unless it is blank."""
    return F.coalesce(F.nullif(F.trim(mine), F.lit("")), made)


def visible(blocks: Column, hidden: Column, show_all: bool = False, editing: bool = False) -> Column:
    """Blocks that a reader sees: hidden ones only if all are asked for or the post is being edited."""
    gone = F.coalesce(hidden, F.array().cast("array<string>"))
    return blocks if show_all or editing else F.filter(blocks, lambda b: ~F.array_contains(gone, b["id"]))


#: What a list of repositories can be narrowed to, and the rating that it means.
RATED = {"heart": 2, "up": 1, "down": -1, "none": None}


def narrowed(rows: DataFrame, rating: str | None = None, language: str | None = None) -> DataFrame:
    """rows (rating, language) of one rating, where none means that there is none, and of one language; an unknown name narrows nothing."""
    if rating in RATED:
        rows = rows.where(F.col("rating").isNull() if RATED[rating] is None else F.col("rating") == RATED[rating])
    return rows.where(F.col("language") == language) if language else rows


def targets(items: DataFrame, repos: DataFrame) -> DataFrame:
    """kind and id of what a page lets its readers rate: its items (id) and its repositories (repo, in any case)."""
    return items.select(F.lit("item").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(repos.select(F.lit("repo").alias("kind"), F.lower("repo").alias("id")))
