"""Ranked search against every score written out."""

import random
import re
from math import floor, log

import numpy as np
import pytest

from gleanery.llm import ranked


def scored(docs, items, k):
    pattern = re.compile(ranked.TERM)
    fold = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(d, fold(t)) for d, t in docs]
    held = [(d, t) for d, t in terms if t]
    n, whole = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, t in held:
            m = 100 - 90 + 90 * len(t) * n // whole
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(fold(text)) if x in t)
            found += [(-s, d is None, d or 0)] * (s > 0)
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=3, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as terms").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id", "3 as score", "4 as size")
    return sorted((tuple(r) for r in ranked.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_scores(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(ranked, "SLICE", rng.choice([60, 400, 1 << 20]))
    monkeypatch.setattr(ranked, "BLOCK", rng.choice([8, 1000]))
    vocabulary = ["A", "b", "ÁB", "áb", "c1", "Zeta", "x-y", "日本", "é", "q"]
    text = lambda most: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00", "_"]) for _ in range(rng.randint(0, most)))
    docs = [(i // 2 if i > 50 else i, text(30)) for i in range(70)] + [(None, "b q b"), (900, None), (901, " !? "), (902, "a " * 3000)]
    docs += [(1000 + i, "b c1 q") for i in range(40)]
    items = [(i, text(6)) for i in range(9)] + [(3, "b b q"), (None, "zeta q"), (77, None), (78, "--"), (79, "unknown")]
    assert run(spark, docs, items, k=5) == scored(docs, items, 5)


def test_none(spark):
    assert run(spark, [], [(1, "a")], parts=1) == [] and run(spark, [(1, "a")], [], parts=1) == [] and run(spark, [(1, None), (2, "")], [(1, "a")], parts=1) == []
    assert run(spark, [(1, "a")], [(1, "A a")], parts=1) == [(1, 1, 1, 287 * (1000000000 // (1000 + 8 * 100)))]


def test_accumulators_are_limited():
    """Of a rare term and many common ones, only documents with the rare one, or enough of the rest, get an accumulator."""
    rng = np.random.default_rng(2)
    n, terms = 4000, 12
    holders = [6, 9, *(int(n * s) for s in np.linspace(0.3, 0.9, terms - 2))]
    places = [np.sort(rng.choice(n, h, replace=False)).astype("<i4") for h in holders]
    row = {"ids": list(range(n)), "lengths": np.full(n, 50, "<i8").tobytes(), "terms": list(range(terms)), "holders": holders, "places": np.concatenate(places).tobytes(), "counts": np.ones(sum(holders), "<i8").tobytes()}
    weights = {t: ranked.weight(n, h) for t, h in enumerate(holders)}
    part = ranked.Postings(row, weights, n, 50 * n)
    got = part.best(list(range(terms)), 5)
    sums = np.zeros(n, np.int64)
    for t, p in enumerate(places):
        sums[p] += weights[t] * (1000000000 // (1000 + 8 * 100))
    best = sorted(((s, i) for i, s in enumerate(sums.tolist())), key=lambda x: (-x[0], x[1]))[:5]
    assert sorted(got, key=lambda x: (-x[0], x[1]))[:5] == best and part.made < n / 10
    assert part.best(list(range(terms)), 5, best[0][0] + 1) == []


def test_lengths_of_any_size():
    assert ranked.damped(np.array([1, 10**9]), 10**12, 10**15).tolist() == [10, 10 + 90 * 10**9 * 10**12 // 10**15]
