"""Repeated stories: by link and by headline."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.tables import written
from .components import components
from .ranking import first_per

#: Two headlines this alike tell one story.
SAME_STORY = 0.6
#: Headlines of a word up to which it brings them together alone.
OFTEN = 256
#: Bits of a headline's parity of words.
BITS = 256


def keep_first(rows: DataFrame, key: str, order: list, title: str | None = None) -> DataFrame:
    """One row a key, the first in order; rows without a title never claim a key."""
    return first_per(rows.where(F.coalesce(F.trim(title), F.lit("")) != "") if title else rows, [key], order)


def not_stored(rows: DataFrame, stored: DataFrame, key: Column | str) -> DataFrame:
    """Rows whose key isn't among the stored ones."""
    return rows.join(stored, key, "left_anti")


def headlines(rows: DataFrame) -> DataFrame:
    """id, words of the distinct word sets among rows (id, words), each under its least id; empty sets are like nothing and left out."""
    return rows.where(F.size("words") > 0).groupBy("words").agg(F.min("id").alias("id")).select("id", "words")


def alike(left: DataFrame, right: DataFrame | None = None, least: float = SAME_STORY) -> DataFrame:
    """Pairs a, b, similarity of distinct headlines (id, words) with a Jaccard similarity of ``least`` or more.

    Without ``right``, pairs a < b of left alone.  Only headlines that share
    one of the words that any partner must share meet: of a set's words in one
    order, rarest first, the first n - ceil(least * n) + 1.  If the first word
    that two share has more than OFTEN headlines, all that they share have.
    Above a half they share two at least, so that such words need to meet by
    pairs of them alone, among one word more.  Who meets is told apart by a
    parity of the words in BITS bits, which differs in no more places than the
    sets do; only what is left is compared word by word.
    """
    by_two = least > 0.5
    both = left.select("words") if right is None else left.select("words").unionAll(right.select("words"))
    # a word that one headline has meets none
    df = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    bit = F.pmod(F.xxhash64("word"), F.lit(BITS))
    parts = [f"s{i}" for i in range(BITS // 64)]

    def keys(rows: DataFrame, name: str) -> DataFrame:
        bits = rows.select("id", F.explode("words").alias("word")).join(df, "word").withColumn("bit", bit)
        parity = [F.bit_xor(F.expr(f"if(bit div 64 = {i}, shiftleft(1L, cast(bit % 64 as int)), 0L)")).alias(f"{name}{x}") for i, x in enumerate(parts)]
        own = bits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by"), *parity)
        n = F.size("by")
        first = lambda more: F.slice("by", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1 + more).cast("int"))
        often = (F.lit(OFTEN) if by_two else F.lit(2**62)).cast("long")
        found = F.transform(F.filter(first(0), lambda x: (x["df"] > 1) & ((x["df"] <= often) | (n == 1))), lambda x: F.xxhash64(x["word"]))
        if by_two:
            own = own.withColumn("most", F.filter(first(1), lambda x: x["df"] > often)["word"])
            pairs = F.transform("most", lambda x, i: F.transform(F.slice("most", i + 2, F.greatest(F.size("most") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y)))
            found = F.concat(found, F.flatten(pairs))
        return own.select(F.col("id").alias(name), n.alias(f"{name}n"), *(f"{name}{x}" for x in parts), F.explode(found).alias("key"))

    n, m = F.col("an"), F.col("bn")
    met = keys(left, "a").join(keys(left if right is None else right, "b"), "key")
    apart = sum((F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in parts[1:]), F.bit_count(F.col(f"a{parts[0]}").bitwiseXOR(F.col(f"b{parts[0]}"))))
    met = met.where((n >= least * m - 1e-9) & (m >= least * n - 1e-9) & (apart <= (n + m) * ((1 - least) / (1 + least)) + 1e-6))
    if right is None:
        met = met.where("a < b")
    met = met.select("a", "b").distinct()
    words = lambda rows, name: rows.select(F.col("id").alias(name), F.col("words").alias(f"w{name}"))
    met = met.join(words(left, "a"), "a").join(words(left if right is None else right, "b"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return met.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def headline_links(rows: DataFrame, least: float = SAME_STORY) -> DataFrame:
    """a, b, similarity over rows (id, words): pairs between the least ids of alike distinct headlines, and each other row of a headline under its least id, at 1."""
    rows = written(rows)
    sets = written(headlines(rows))
    same = rows.join(sets.withColumnRenamed("id", "a"), "words").where("id <> a")
    return alike(sets, least=least).unionAll(same.select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def _replay(least: float):
    """Slots of components whose rows (component, id, words, weight) come in order; held are the words of the holders of one component's slots."""

    def slots(batches):
        component, held, having = None, [], {}

        def settled():
            return pd.DataFrame({"pos": [h[1] for h in held], "slot": [h[0] for h in held]})

        for batch in batches:
            for at, pos, own, weight in batch[["component", "id", "words", "weight"]].itertuples(index=False):
                if at != component:
                    yield settled()
                    component, held, having = at, [], {}
                near = Counter(i for w in own for i in having.get(w, ()))
                twin = min((i for i, n in near.items() if n / (len(own) + len(held[i][3]) - n) >= least - 1e-12), default=None)
                if twin is None:
                    twin = len(held)
                    held.append((pos, pos, weight, own))
                elif weight > held[twin][2]:
                    for w in held[twin][3]:
                        having[w].discard(twin)
                    held[twin] = (held[twin][0], pos, weight, own)
                else:
                    continue
                for w in own:
                    having.setdefault(w, set()).add(twin)
        yield settled()

    return slots


def drop_repeated(candidates: DataFrame, covered: DataFrame, least: float = SAME_STORY) -> DataFrame:
    """pos, slot of the candidates that stay.

    candidates: pos (their order), title, weight (null: the least); covered:
    title.  A candidate like a covered headline goes.  The rest is taken in
    order: one like the holder of a slot, the first such, takes the slot if its
    weight is greater, else goes; another opens a slot.  Headlines without
    words are like nothing.  A headline that no other is like is settled by one
    aggregate, however many candidates have it; components of alike headlines
    are replayed in order, streamed.
    """
    rows = written(candidates.select(F.col("pos").cast("long").alias("id"), words(F.col("title")).alias("words"), F.coalesce(F.col("weight").cast("double"), F.lit(float("-inf"))).alias("weight")))
    sets = written(headlines(rows))
    old = written(covered.select(words(F.col("title")).alias("words")).where(F.size("words") > 0).distinct().select(F.monotonically_increasing_id().alias("id"), "words"))
    fresh = written(sets.join(alike(sets, old, least).select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
    member = components(alike(fresh, least=least).select("a", "b"))
    named = rows.join(fresh.withColumnRenamed("id", "headline").join(member.withColumnRenamed("node", "headline"), "headline", "left"), "words")
    bare = rows.where(F.coalesce(F.size("words"), F.lit(0)) <= 0).select(F.col("id").alias("pos"), F.col("id").alias("slot"))
    alone = named.where("component is null").groupBy("headline").agg(F.min_by("id", F.struct(-F.col("weight"), F.col("id"))).alias("pos"), F.min("id").alias("slot")).drop("headline")
    ordered = named.where("component is not null").select("component", "id", "words", "weight").repartition("component").sortWithinPartitions("component", "id")
    return bare.unionByName(alone).unionByName(ordered.mapInPandas(_replay(least), "pos long, slot long"))
