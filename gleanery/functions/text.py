"""Text columns: folding, headline words, ids, summaries, tags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values
STOP_WORDS = ["the", "a", "an", "of", "to", "in", "on", "for", "and", "with", "is", "are", "at", "by", "from", "new", "how", "why", "what", "its", "it", "as", "your", "you"]
TAGS = {
    "inference": r"inference|latency|throughput|tokens? per second",
    "quantization": r"quantiz\w*|gguf|ggml|awq|gptq|int[48]|fp8|4-bit|8-bit",
    "runtime": r"llama\.cpp|vllm|ollama|onnx|tensorrt|mlx|runtime",
    "serving": r"serving|deployment|kubernetes|autoscal\w*|self-host\w*",
    "fine-tuning": r"fine-?tun\w*|lora|qlora|sft|instruction[- ]tun\w*",
    "training": r"pre-?training|post-?training|training run|training data|gpu cluster",
    "agents": r"agents?|agentic|mcp|tool use|function calling",
    "evals": r"evals?|evaluations?",
    "benchmarks": r"benchmarks?|leaderboard|swe-bench|mmlu|arena",
    "reasoning": r"reasoning|chain[- ]of[- ]thought|thinking models?",
    "multimodal": r"multimodal|vision|image generation|text-to-image|video generation|speech|audio",
    "rag": r"rag|retrieval|embeddings?|vector (?:db|database|search)|reranker",
    "safety": r"safety|jailbreaks?|red[- ]team\w*|misuse|guardrails?",
    "alignment": r"alignment|rlhf|constitutional|reward model",
    "open-weights": r"open[- ]weights?|open[- ]source model|apache 2\.0|hugging ?face",
    "tooling": r"sdk|library|framework|cli|toolkit|api",
    "policy": r"regulation|policy|legislation|lawsuit|copyright|government|eu ai act",
    "funding": r"raises?|funding|series [a-d]|valuation|acquires?|acquisition|investors?",
}
SENTENCE = r"[^.!?]+(?:[.!?]+(?=\s|$)|$)"
SUMMARY_TARGET, SUMMARY_MAX, TAG_CHARS, TAGS_MAX, TITLE_MAX = 280, 600, 4000, 4, 300
#: White space as browsers see it.
BLANK = r"[\s ﻿ -     　 ]+"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without accents. Spark has no normalisation of its own, so this is the one hop to Python."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not 0x300 <= ord(c) <= 0x36F))


def words(title: Column) -> Column:
    """Distinct telling words of a headline, sorted."""
    bits = F.filter(F.split(fold(title), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) | w.rlike(r"^\d$"))
    return F.array_sort(F.array_except(F.array_distinct(bits), F.array(*map(F.lit, STOP_WORDS))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def strip_html(text: Column) -> Column:
    """Tags and entities as spaces, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&[#\w]+;", " "))


def slugify(text: Column, most: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, most), "-+$", "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, eight hex digits."""
    fold_in = lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * 16777619).bitwiseAND(4294967295)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    digits = F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), fold_in)))
    return F.when(text == "", "811c9dc5").otherwise(F.lpad(digits, 8, "0"))


def short_hash(text: Column) -> Column:
    return F.substring(fnv1a(text), 1, 6)


def item_id(category: Column, compact_week: Column, title: Column, url: Column) -> Column:
    """<category>-<week>-<slug>-<hash of the link as given>, 120 characters at most; never changes once given."""
    slug = slugify(title)
    return F.substring(F.concat_ws("-", category, compact_week, F.when(slug == "", "item").otherwise(slug), short_hash(url)), 1, 120)


def lead_summary(text: Column) -> Column:
    """Leading sentences: to 280 characters or more where there are, never past 600; a text of marks alone is its own lead."""
    found = F.regexp_extract_all(collapse(text), F.lit(SENTENCE), F.lit(0))
    bits = F.transform(let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(collapse(text)))), lambda s: F.struct(F.trim(s).alias("s"), F.length(s).alias("n")))

    def step(a: Column, x: Column) -> Column:
        lead = a["lead"]
        done = a["done"] | ((lead != "") & (F.length(lead) + x["n"] > SUMMARY_MAX))
        new = F.trim(F.concat_ws(" ", lead, x["s"]))
        return F.struct(F.when(done, lead).otherwise(new).alias("lead"), (done | (F.length(F.when(done, lead).otherwise(new)) >= SUMMARY_TARGET)).alias("done"))

    lead = F.aggregate(bits, F.struct(F.lit("").alias("lead"), F.lit(False).alias("done")), step, lambda a: a["lead"])
    cut = lambda x: F.concat(F.regexp_replace(F.substring(x, 1, SUMMARY_MAX), r"\s\S*$", ""), F.lit("…"))
    return let(lead, lambda x: F.when(F.length(x) <= SUMMARY_MAX, x).otherwise(cut(x)))


def bounded(pattern: str) -> str:
    """The pattern as a whole ASCII word, any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def keyword_tags(title: Column, text: Column, tags: dict[str, str] | None = None, most: int = TAGS_MAX) -> Column:
    """Tags with two hits or more, a title's counting double, most hits first, then in the vocabulary's order.

    Most texts hit none of the service's tags: one scan for all of them finds
    that out, and only the others are scanned for each.
    """
    own = tags or TAGS
    head, body = F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, TAG_CHARS)
    groups = [{t: p for t, p in own.items() if (t in TAGS) is service} for service in (True, False)]
    count = lambda p: F.regexp_count(body, F.lit(bounded(p))) + 2 * F.regexp_count(head, F.lit(bounded(p)))
    place, kind = {t: i for i, t in enumerate(own)}, "array<struct<n:int,i:int,t:string>>"

    def hits(group: dict[str, str]) -> Column:
        every = F.lit(bounded("|".join(group.values())))
        rows = F.array(*(F.struct((-count(p)).alias("n"), F.lit(place[t]).alias("i"), F.lit(t).alias("t")) for t, p in group.items()))
        return F.when(F.rlike(body, every) | F.rlike(head, every), rows.cast(kind)).otherwise(F.array().cast(kind))

    found = [hits(group) for group in groups if group]
    return F.transform(F.slice(F.array_sort(F.filter(F.concat(*found), lambda x: x["n"] <= -2)), 1, most), lambda x: x["t"])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")).cast("long")


def read_minutes(text: Column, video: Column | None = None) -> Column:
    """At 220 words a minute, one at least; null under ten words and for videos."""
    n = word_count(text)
    return F.when((n >= 10) & (F.lit(True) if video is None else ~F.coalesce(video, F.lit(False))), F.greatest(F.lit(1), F.floor(n / 220 + 0.5)).cast("long"))


def trim_byline(text: Column) -> Column:
    """120 characters at most, cut at the last comma there."""
    head = F.substring(text, 1, 120)
    return F.when(F.length(text) <= 120, text).otherwise(F.when(head.contains(","), F.regexp_replace(head, r",[^,]*$", "")).otherwise(head))


def author_list(authors: Column) -> Column:
    """Up to three names, then et al."""
    return F.when(F.size(authors) > 3, F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(authors, ", "))


def format_stars(n: Column) -> Column:
    """152K, 1.5K, 3M."""
    short = lambda x, unit: F.concat(F.regexp_replace((F.floor(x * 10 + 0.5) / 10).cast("string"), r"\.0$", ""), F.lit(unit))
    big = lambda x, unit: F.when(x < 100, short(x, unit)).otherwise(F.concat(F.floor(x + 0.5).cast("string"), F.lit(unit)))
    return F.when(n < 1000, n.cast("string")).when(n < 999_500, big(n / 1000, "K")).otherwise(big(n / 1_000_000, "M"))


def repo_line(language: Column, stars: Column, score: Column) -> Column:
    """The line under a repository's name: language, stars, score; a dash for what isn't known."""
    said = lambda x: F.coalesce(x, F.lit("—"))
    return F.concat(said(language), F.lit(" · ★ "), said(format_stars(stars)), F.lit(" · "), said(F.concat(score.cast("string"), F.lit("/100"))))


def week_span(first: Column, last: Column) -> Column:
    """W36–W39, or W38 for a single week."""
    return F.when(first == last, F.substring(last, 6, 8)).otherwise(F.concat(F.substring(first, 6, 8), F.lit("–"), F.substring(last, 6, 8)))


def timestamp_label(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("long"))).otherwise(F.format_string("%d:%02d", m, s.cast("long")))


def original_text(value: Column) -> Column:
    """A localized value's English, else its Hungarian."""
    return F.coalesce(F.nullif(value["en"], F.lit("")), value["hu"])


def in_both(value: Column) -> Column:
    return F.struct(value.alias("hu"), value.alias("en"))


def original_list(value: Column) -> Column:
    """A localized list's English, else its Hungarian."""
    return F.when(F.size(value["en"]) > 0, value["en"]).otherwise(value["hu"])
