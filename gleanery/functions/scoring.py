"""Rule and final scores of candidates, their category and reading time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bounded

# fixed values
LOCAL = r"ollama|llama\.cpp|gguf|ggml|vllm|lm studio|local(?:ly)?|on-device|open[- ]weights?|quantiz\w*|self-host\w*|run (?:it )?on (?:your|a) (?:laptop|gpu|mac)"
RESEARCH = r"paper|arxiv|benchmark|dataset|we (?:propose|present|show)|study|survey|theorem|ablation"
CATEGORIES = ["local", "research", "companies", "github"]
NEUTRAL_RELEVANCE, NEUTRAL_PROMOTION, PROMOTION_MOST, PUBLISH_LEAST = 0.5, 0.0, 0.6, 35


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rule_score(weight: Column, published: Column, points: Column, now: Column) -> Column:
    """Trust of the source, freshness (two days' half-life from noon UTC) and popularity."""
    noon = F.unix_timestamp(published.cast("timestamp")) + 12 * 3600
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - noon) / 86400)
    return 0.45 * F.least(weight / 1.5, F.lit(1.0)) + 0.3 * F.pow(F.lit(0.5), age / 2) + 0.25 * F.least(F.log1p(points) / F.log1p(F.lit(500.0)), F.lit(1.0))


def final_score(rule: Column, relevance: Column, promotion: Column) -> Column:
    """0 to 99; a missing judgement is neutral."""
    relevance, promotion = F.coalesce(relevance, F.lit(NEUTRAL_RELEVANCE)), F.coalesce(promotion, F.lit(NEUTRAL_PROMOTION))
    base = 0.7 * relevance + 0.3 * clamp((rule - 0.35) / 0.4)
    return clamp(F.floor(100 * F.when(promotion > PROMOTION_MOST, base * 0.3).otherwise(base) + 0.5), 0, 99).cast("int")


def category_for(hint: Column, source: Column, title: Column) -> Column:
    open_ = (hint == "companies") & source.startswith("Hacker News")
    return F.when(~open_, hint).when(title.rlike(bounded(LOCAL)), "local").when(title.rlike(bounded(RESEARCH)), "research").otherwise("companies")


def estimate_minutes(url: Column, hint: Column, source: Column) -> Column:
    return F.when(url.contains("arxiv.org") | (hint == "research"), 20).when(source.startswith("Hacker News"), 6).when(hint == "local", 8).otherwise(5)


def judgement(score: Column, promotion: Column, category: Column) -> Column:
    """struct(relevance, promotion, category) of a model's answer; null if it makes no sense."""
    good = score.isNotNull() & promotion.isNotNull() & category.isin("local", "research", "companies")
    return F.when(good, F.struct(clamp(score / 4).alias("relevance"), promotion.alias("promotion"), category.alias("category")))


def publishable(score: Column, promotion: Column) -> Column:
    return (F.coalesce(promotion, F.lit(0.0)) <= PROMOTION_MOST) & (score >= PUBLISH_LEAST)
