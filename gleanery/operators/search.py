"""Search: boolean words, typo-tolerant titles, ranks, the union over kinds.

Rows are indexed once: a table of words with their places, one of the titles'
trigrams, both in the order of their keys, so that a query reads what it asks
for.  A query then joins what it found there and measures titles of its
candidates alone.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations
from math import exp, sqrt
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import written

SIMILAR, SHORTEST, LONGEST = 0.45, 2, 100
#: Characters of a hit's snippet.
SNIPPET = 240


def normal(query: str) -> str:
    """White space collapsed, 100 characters at most; '' if under two."""
    query = re.sub(r"\s+", " ", query).strip()[:LONGEST].strip()
    return query if len(query) >= SHORTEST else ""


def tokens(text: Column) -> Column:
    """Lower-cased words in order; neither stems nor stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


def parsed(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives by or, each a list of terms: whether it is refused, and its words (several are a phrase)."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
        elif own := _split(phrase or word):
            groups[-1].append((bool(minus), own))
    return [g for g in groups if g]


def _meets(groups: list[list[tuple[bool, list[str]]]], hit) -> Column:
    found = [reduce(Column.__and__, (~hit(words) if minus else hit(words) for minus, words in g)) for g in groups]
    return reduce(Column.__or__, found) if found else F.lit(False)


def matches(have: Column, query: str) -> Column:
    """Whether words meet a query: all of its terms, "phrases", alternatives by or, none behind a minus."""
    padded = F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" "))
    return _meets(parsed(query), lambda own: F.array_contains(have, own[0]) if len(own) == 1 else padded.contains(f" {' '.join(own)} "))


def trigrams(text: str) -> list[str]:
    """Three-letter runs of each word with two blanks before and one after, in order."""
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def title_trigrams(title: Column) -> Column:
    """The distinct trigrams of a title."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def best_extent(needle: set[str], own: list[str]) -> float:
    """Greatest Jaccard similarity of the needle's trigrams and those of a run of the text's."""
    if not needle or not own:
        return 0.0
    spots = [i for i, t in enumerate(own) if t in needle]
    best = 0.0
    for a, i in enumerate(spots):
        seen: set[str] = set()
        at = i
        for j in spots[a:]:
            seen.update(own[at : j + 1])
            at = j + 1
            both = len(seen & needle)
            best = max(best, both / (len(needle) + len(seen) - both))
    return best


def word_similarity(needle: str, title: Column) -> Column:
    """Similarity of the needle to the best run of a title; one Arrow hop over titles alone."""
    wanted = set(trigrams(needle))

    @F.pandas_udf(DoubleType())
    def measure(titles: pd.Series) -> pd.Series:
        return titles.map(lambda x: best_extent(wanted, trigrams(x or "")))

    return measure(title)


# fixed values of the rank: places kept of a word, the last place, the weight of a word, the sum of 1 / k^2, and what a rank without any pair is
MOST_PLACES, LAST_PLACE, WEIGHT, SQUARES, NO_PAIR = 256, 16383, 0.1, 1.64493406685, 1e-20


def _near(distance: int) -> float:
    """What two words so far apart add: the root of their weights and of 1 / (1.005 + 0.05 e^(distance / 1.5 - 2)); nothing beyond 100."""
    return sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * exp(distance / 1.5 - 2))) if distance <= 100 else 0.0


def rank(have: Column, query: str) -> Column:
    """Rank of a row by the places of its words (a map). have: word to places.

    Of one word, or of alternatives: for each word the sum over its places of
    weight / k^2 for the kth, scaled by the sum of all 1 / k^2, and the mean
    over the query's words.  Of several words together: 1 less the product,
    over all pairs of places of two words, of 1 less what their distance adds.
    """
    groups = parsed(query)
    words = sorted({w for g in groups for _, own in g for w in own})
    places = [F.coalesce(have[w], F.array().cast("array<int>")) for w in words]
    if len(groups) == 1 and len(words) > 1:
        adds = F.array(*(F.lit(1 - _near(n)) for n in range(101)))
        left = lambda x, y: F.coalesce(F.when(x != y, F.get(adds, F.abs(x - y))), F.lit(1.0))
        pair = lambda a, b: F.aggregate(a, F.lit(1.0), lambda s, x: s * F.aggregate(b, F.lit(1.0), lambda t, y: t * left(x, y)))
        found = F.lit(1.0) - reduce(Column.__mul__, (pair(a, b) for a, b in combinations(places, 2)))
        return F.when(found > 0, found).otherwise(NO_PAIR)
    each = [F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0.0), lambda s, k: s + WEIGHT / (k * k)) for p in places]
    return reduce(Column.__add__, (F.when(F.size(p) > 0, e / SQUARES).otherwise(0.0) for p, e in zip(places, each))) / len(words) if words else F.lit(0.0)


class Tables(NamedTuple):
    """What a search reads: the rows (kind, id, title, snippet, href, url, meta), words with their places, trigrams of titles."""

    rows: DataFrame
    words: DataFrame
    grams: DataFrame


def index(kinds: dict[str, DataFrame], query: str | None = None) -> Tables:
    """Index frames of id, title, body, snippet, href, url, meta, by the name of their kind; for one query alone, of all rows the words and trigrams that it asks for.

    Words and trigrams are sorted over all files, so that a query's keys are
    found by the files' and row groups' least and greatest ones.  A common
    word's rows are spread by id.
    """
    fields = ("title", "snippet", "href", "url", "meta")
    whole = reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), *fields, "body") for kind, rows in kinds.items()))
    own, grams = F.posexplode(tokens(F.concat_ws(" ", "title", "body"))).alias("at", "token"), title_trigrams(F.col("title"))
    told = whole.select("kind", "id", own)
    if query is None:
        told = told.repartitionByRange("token", "kind", "id")
    else:
        told = told.where(F.col("token").isin(asked(query)))
        grams = F.filter(grams, lambda g: g.isin(sorted(set(trigrams(normal(query))))))
    places = F.slice(F.array_distinct(F.array_sort(F.collect_list(F.least(F.col("at") + 1, F.lit(LAST_PLACE))))), 1, MOST_PLACES)
    words = told.groupBy("token", "kind", "id").agg(places.alias("places")).sortWithinPartitions("token", "kind", "id")
    grams = whole.select("kind", "id", F.explode(grams).alias("gram"))
    if query is None:
        grams = grams.repartitionByRange("gram", "kind", "id").sortWithinPartitions("gram")
    rows = whole.select("kind", "id", *fields).withColumn("snippet", F.substring("snippet", 1, SNIPPET))
    return Tables(written(rows), written(words), written(grams))


def asked(query: str) -> list[str]:
    """The words that a query asks for."""
    return sorted({w for g in parsed(normal(query)) for _, own in g for w in own})


def similar_titles(tables: Tables, needle: str) -> DataFrame:
    """kind, id and the number of the needle's trigrams that the title shares, where it shares any."""
    return tables.grams.where(F.col("gram").isin(sorted(set(trigrams(needle))))).groupBy("kind", "id").agg(F.count("*").alias("shared"))


def search_all(tables: Tables | dict[str, DataFrame], query: str, limit: int = 40) -> DataFrame:
    """kind, id, title, snippet, href, url, meta, rank of the best hits over all kinds.

    tables: of ``index`` (or its input, indexed for this query alone).  A row
    is a hit if its words meet the query or its title is like it.  Rank is
    twice the words' and the title's; ties go by kind and id.
    """
    query, limit = normal(query), min(max(limit, 1), 100)
    tables = tables if isinstance(tables, Tables) else index(tables, query)
    groups, needle, keys = parsed(query), set(trigrams(query)), ["kind", "id"]
    have = tables.words.where(F.col("token").isin(asked(query))).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("have"))
    if any(all(minus for minus, _ in g) for g in groups):  # rows without any of the words may be hits
        have = tables.rows.select(*keys).join(have, keys, "left")

    def hit(own: list[str]) -> Column:
        places = [F.col("have")[w] for w in own]
        if len(own) == 1:
            return F.coalesce(places[0].isNotNull(), F.lit(False))
        return F.coalesce(F.exists(places[0], lambda p: reduce(Column.__and__, (F.array_contains(other, p + i) for i, other in enumerate(places[1:], 1)))), F.lit(False))

    said = have.withColumn("met", _meets(groups, hit))
    found = said.join(similar_titles(tables, query), keys, "full")
    # a title that shares fewer trigrams can't be alike enough
    able = found.where(F.coalesce("met", F.lit(False)) | (F.coalesce("shared", F.lit(0)) > SIMILAR * len(needle)))
    rows = tables.rows.join(able, keys).withColumn("_sim", word_similarity(query, F.when(F.col("shared") > 0, F.col("title"))))
    hits = rows.where((F.coalesce("met", F.lit(False)) | (F.col("_sim") > SIMILAR)) & F.lit(bool(query)))
    ranked = (rank(F.coalesce("have", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>"))), query) * 2 + F.col("_sim")).cast("float")
    out = hits.select("kind", "id", "title", F.substring("snippet", 1, SNIPPET).alias("snippet"), "href", "url", "meta", ranked.alias("rank"))
    return out.orderBy(F.desc("rank"), "kind", "id").limit(limit)
