"""The work queue of links: claims, retries, closing of stuck rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_key

LEASE_MINUTES, ATTEMPTS, BATCH = 10, 3, 10


def claimed(now: Column) -> Column:
    """A claim that is less than a lease old."""
    return F.coalesce(F.col("claimed_at") > now - F.expr(f"interval {LEASE_MINUTES} minutes"), F.lit(False))


def due(queue: DataFrame, n: int = BATCH) -> DataFrame:
    return queue.where((F.col("status") != "done") & (F.col("attempts") < ATTEMPTS)).orderBy("id").limit(n)


def claim(queue: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Compare and swap: rows whose attempts are still those seen (wanted: id, seen) and that aren't claimed get one attempt more."""
    rows = queue.join(wanted, "id", "left")
    hit = F.coalesce(F.col("seen") == F.col("attempts"), F.lit(False)) & ~claimed(now)
    return rows.withColumns({"won": hit, "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")), "claimed_at": F.when(hit, now).otherwise(F.col("claimed_at"))}).drop("seen")


def close_stuck(queue: DataFrame, now: Column) -> DataFrame:
    """Pending rows out of attempts and without a live claim have failed."""
    stuck = (F.col("status") == "pending") & (F.col("attempts") >= ATTEMPTS) & ~claimed(now)
    return queue.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def retry(queue: DataFrame, ids: DataFrame, owner: Column) -> DataFrame:
    """Failed rows of the owner are pending again with no attempts."""
    rows = queue.join(ids.select("id", F.lit(True).alias("asked")), "id", "left")
    hit = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("owner") == owner) & (F.col("status") == "failed")
    return rows.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts"))}).drop("asked")


def finish(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Results (id, error, has_post): success is done; an error fails, but a row with a post keeps its status; the message is cut at 500. A row without a result stays as it is."""
    rows = queue.join(results, "id", "left")
    answered = F.col("has_post").isNotNull()
    status = F.when(answered & F.col("error").isNull(), "done").when(answered & ~F.col("has_post"), "failed").otherwise(F.col("status"))
    told = F.substring("error", 1, 500)
    error = F.when(answered, told).otherwise(F.col("last_error")) if "last_error" in queue.columns else told
    return rows.withColumns({"status": status, "last_error": error}).drop("error", "has_post")


def library_state(post_id: Column, status: Column, attempts: Column) -> Column:
    """struct(state, post_id) of an item's copy."""
    open_ = (status != "done") & (attempts < ATTEMPTS)
    return F.struct(F.when(post_id.isNotNull(), "post").when(F.coalesce(open_, F.lit(False)), "pending").otherwise("unavailable").alias("state"), post_id.alias("post_id"))


def read_here(items: DataFrame, sources: DataFrame, posts: DataFrame) -> DataFrame:
    """id and copy (state, post_id) of every item whose link has a source, links compared in their one form.

    items: id, url; sources: source_id, url, status, attempts; posts:
    source_id, post_id.  Of several sources of a link the least id counts.
    """
    known = sources.join(posts.select("source_id", "post_id"), "source_id", "left").groupBy(url_key(F.col("url")).alias("_key"))
    first = known.agg(F.min_by(F.struct("post_id", "status", "attempts"), "source_id").alias("_s"))
    found = items.select("id", url_key(F.col("url")).alias("_key")).join(first, "_key")
    return found.select("id", library_state(F.col("_s.post_id"), F.col("_s.status"), F.col("_s.attempts")).alias("copy"))
