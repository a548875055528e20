"""The daily run: candidates to a week's issue and the day's list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..functions.dates import budapest_day, iso_week, week_compact
from . import dedupe, ingest, publish, ranking

JUDGED, PUBLISHED, LISTED, LOOKBACK_DAYS = 60, 25, 10, 14


def fresh_candidates(candidates: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Candidates (priority, pos, title, url, weight, ...) that no stored item of two weeks has, by link or by headline; of several of one link the first."""
    recent = stored.where(F.col("created_at") >= now - F.expr(f"interval {LOOKBACK_DAYS} days"))
    keyed = dedupe.keep_first(candidates.withColumn("url_key", urls.url_key(F.col("url"))), "url_key", ["priority", "pos"], "title")
    new = dedupe.not_stored(keyed, recent.select(urls.url_key(F.col("url")).alias("url_key")).distinct(), "url_key")
    kept = dedupe.drop_repeated(new.select((F.col("priority") * 1_000_000_000 + F.col("pos")).alias("pos"), "title", "weight"), recent.select("title"))
    place = (F.col("priority") * 1_000_000_000 + F.col("pos")).alias("order")
    return new.withColumn("order", place).join(kept.select(F.col("pos").alias("order"), "slot"), "order")


def scored(candidates: DataFrame, now: Column, judge: Callable | None = None) -> DataFrame:
    """The 25 best: rule scores keep 60, a judge or neutral values make the final score, likely promotions and scores under 35 go."""
    rule = scoring.rule_score(F.col("weight"), F.col("published"), F.col("points"), now)
    rows = candidates.withColumn("rule", rule).orderBy(F.desc("rule"), "slot").limit(JUDGED).withColumn("pos", F.col("slot"))
    if judge:
        rows = ingest.judged(rows, judge)
        answer = scoring.judgement(F.col("answer.score"), F.col("answer.promotion"), F.col("answer.category"))
    else:
        answer = F.lit(None).cast("struct<relevance:double,promotion:double,category:string>")
    rows = rows.withColumn("j", answer)
    rows = rows.withColumn("score", scoring.final_score(F.col("rule"), F.col("j.relevance"), F.col("j.promotion"))).where(scoring.publishable(F.col("score"), F.col("j.promotion")))
    category = F.coalesce("j.category", scoring.category_for(F.col("hint"), F.col("source"), F.col("title")))
    return rows.withColumn("category", category).withColumn("read_minutes", scoring.estimate_minutes(F.col("url"), F.col("hint"), F.col("source"))).orderBy(F.desc("score"), "slot").limit(PUBLISHED).drop("j", "rule")


def issue_items(rows: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """The rows that are written: new links only, with their frozen ids and week."""
    day = F.to_date(now)
    items = rows.select(text.item_id(F.col("category"), week_compact(day), F.col("title"), F.col("url")).alias("id"), iso_week(day).alias("issue_id"), "url", "title", "source", "category", "score", "read_minutes", now.alias("created_at"))
    return publish.insert_if_absent(stored, items, "url", ["id"])


def day_list(items: DataFrame, now: Column) -> DataFrame:
    """The day's ten with their ranks, by the local day of each item."""
    today = items.withColumn("day", budapest_day(F.col("created_at"))).where(F.col("day") == budapest_day(now))
    return ranking.daily_top(today, ["day"], F.col("read_minutes") <= 15, [F.desc("score"), "id"], LISTED).select("day", "rank", F.col("id").alias("item_id"))


def run(candidates: DataFrame, stored: DataFrame, now: Column, judge: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(items to add, the day's list over all items) of one run."""
    new = issue_items(scored(fresh_candidates(candidates, stored, now), now, judge), stored, now)
    return new, day_list(stored.select(new.columns).unionByName(new), now)
