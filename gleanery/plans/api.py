"""The service's calls as functions of frames: each answers with rows, a change with a new snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import daily, ingest, publish, queue, search, serve, state, stored

SEARCH_MOST = 8


def get_search(tables: search.Tables | dict[str, DataFrame], query: str) -> DataFrame:
    return search.search_all(tables, query, SEARCH_MOST)


def get_state(there: state.State, viewer: str) -> state.State:
    """The viewer's flags, to-dos (open ones first, the newest first) and ratings."""
    mine = state.State(*(state.own(rows, viewer) for rows in there))
    return mine._replace(todos=mine.todos.orderBy("is_done", F.desc("id")))


def post_state(there: state.State, actions: DataFrame) -> tuple[state.State, DataFrame]:
    """(state after the actions, an answer to each); actions: seq, user_id, body."""
    return state.applied(there, actions)


def reextract(posts: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(posts whose reading was begun again, an answer to each request)."""
    return stored.claim_extraction(posts, requests, now)


def save_posts(posts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts after requests to edit them, an answer to each)."""
    return stored.save_edits(posts, edits)


def post_sources(sources: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to add, links that are there already or can't be taken); links: id, url, owner."""
    keyed = links.withColumn("url_key", urls.url_key(F.col("url"))).withColumn("ok", urls.is_submittable(F.col("url")))
    new = publish.insert_if_absent(sources.select("url_key"), keyed.where("ok"), "url_key", ["id"])
    added = new.select("id", "url_key", urls.detect_source(F.col("url")).alias("kind"), "owner", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    refused = keyed.join(new.select("id"), "id", "left_anti").select("id", "url_key", F.when(F.col("ok"), "duplicate").otherwise("bad link").alias("error"))
    return added, refused


def get_my_sources(sources: DataFrame, posts: DataFrame, viewer: str, n: int = 10) -> DataFrame:
    """The viewer's latest links with the state of their copies."""
    mine = sources.where(F.col("owner") == viewer).join(posts.select(F.col("source_id").alias("id"), "post_id"), "id", "left")
    return mine.withColumn("copy", queue.library_state(F.col("post_id"), F.col("status"), F.col("attempts"))).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def post_retry(sources: DataFrame, ids: DataFrame, viewer: str) -> DataFrame:
    return queue.retry(sources, ids, F.lit(viewer))


def patch_posts(posts: DataFrame, edits: DataFrame, viewer: str) -> DataFrame:
    return ingest.guarded_update(posts, edits, F.lit(viewer))


def get_archive(issues: DataFrame, items: DataFrame, current: str) -> DataFrame:
    """All weeks but the current one, latest first."""
    return serve.archive(issues.where(F.col("issue_id") != current), items).orderBy(F.desc("issue_id"))


def cron_daily(candidates: DataFrame, stored: DataFrame, now: Column, judge: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    return daily.run(candidates, stored, now, judge)


def cron_mirror(items: DataFrame, repos: DataFrame, sources: DataFrame) -> DataFrame:
    """Links to mirror that no source has yet."""
    wanted = publish.mirror_queue(items, repos).withColumn("url_key", urls.url_key(F.col("url")))
    return publish.insert_if_absent(sources.select("url_key"), wanted, "url_key", ["url"])
