"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from gleanery.llm import graph, jaccard


def shingles(text, k=5):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=80, k=5):
    sets = {(-1 if i is None else i): shingles(x, k) for i, x in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent,seed,common,cell", [(80, 0, 2000, 4096), (80, 1, 3, 4096), (60, 2, 3, 6), (95, 3, 2000, 6), (80, 4, 3, 6), (80, 5, 2000, 4)])
def test_against_all_pairs(spark, percent, seed, common, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "CELL_DOCS", cell)
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(12)]
    rows = []
    for _ in range(22):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))] + shared * (rng.random() < 0.7)
        for _ in range(rng.choice([1, 1, 2, 3, 50 if len(rows) < 60 else 1])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: rng.randint(len(text) * 2 // 3, len(text))]
            rows.append((len(rows) * 17 % 997, (" " if rng.random() < 0.5 else "\n").join(text if rng.random() < 0.8 else [w.lower() for w in text])))
    # a group of near misses: most of its pairs stay under the mark
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(40):
        text = list(base)
        for _ in range(rng.choice([1, 2, 2])):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 + len(rows), " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b"), (2004, "a"), (None, rows[0][1]), (2005, "a b c d"), (2006, "É b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as n", "'x' as marks").repartition(3)
    got = jaccard.jaccard_classes(docs, percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    name = lambda i: -1 if i is None else i
    assert {name(r.doc_id): (r.n_shingles, name(r.component_id)) for r in got} == want


def test_very_long_and_repeated_ids(spark):
    rng = random.Random(8)
    long = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    near = list(long)
    near[100] = near[40_000] = "other"
    few = "a b c d e f g"
    rows = [(5, " ".join(long)), (3, " ".join(near)), (9, " ".join(long[:40_000])), (7, few), (7, "h i j k l m"), (8, few), (6, "h i j k l m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted({(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect()})
    # document 7 has two texts and links as each does
    assert got == [(3, 3), (5, 3), (6, 6), (7, 6), (8, 6), (9, 9)]


def test_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "A B c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 900, rng.integers(1, 900)).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        a, b = a >> np.uint64(18), b >> np.uint64(18)
        both = len(np.intersect1d(a, b))
        p, q = jaccard.points(a), jaccard.points(b)
        assert jaccard.bound(p, q, len(a), len(b)) >= both
        assert np.minimum(jaccard.folded(p, 64, len(a)), jaccard.folded(q, 64, len(b))).sum() >= jaccard.bound(p, q, len(a), len(b))
        for percent in (50, 80, 95):
            assert (100 * both >= percent * (len(a) + len(b) - both)) == (both >= jaccard.needed(len(a), len(b), percent))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 5), (5, 1), (7, 7), (None, 3), (50, 1)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}
    real = [(a, b) for a, b in links if a is not None and a != b]
    for a, b in real:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in real:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("docs,block", [(6, 4096), (6, 7), (4096, 7)])
def test_no_text_moves_for_a_chance_meeting(spark, docs, block, monkeypatch):
    """A wide cell of documents that share one passage alone sends its points, not its texts."""
    monkeypatch.setattr(jaccard, "CELL_DOCS", docs)
    monkeypatch.setattr(jaccard, "POINT_DOCS", block)
    tables = {}
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name="table": tables.setdefault(name, keep(frame, name)))
    rng = random.Random(6)
    passage = [rng.choice("abcdefgh") * 3 + str(i) for i in range(40)]
    rows = [(i, [f"{rng.randrange(10**6)}" for _ in range(60)] + passage) for i in range(90)]
    rows += [(100 + i, [*rows[7][1][:i], "changed", *rows[7][1][i + 1 :]]) for i in (3, 50)]
    rows += [(200 + i, [f"{rng.randrange(10**6)}" for _ in range(90 + i)] + passage) for i in range(40)]
    rows.append((300, ["first", *rows[-1][1]]))
    found = jaccard.jaccard_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    want = {i: i for i, _ in rows} | {103: 7, 150: 7, 300: 239}
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc for r in tables["texts"].select("doc").collect()} == {7, 103, 150, 239, 300}


def test_prefixes_share_several():
    """Linked sets have ``shared`` shingles of the smaller one in both prefixes, whichever are very common."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 5, 9, 20, 62, 63, 100, 500):
        for percent in (60, 80, 95):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                b = np.unique(np.concatenate([a[rng.random(n) < rng.choice([0.8, 0.9, 1])], rng.integers(0, 1 << 62, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                doc, at, _ = jaccard.prefix(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.sort(rng.choice(a, n // 3)), percent)
                of = np.concatenate([a, b])[at]
                met = len(np.intersect1d(of[doc == 0], of[doc == 1]))
                sizes = np.array([len(a), len(b)])
                assert met >= jaccard.shared(sizes, percent).min() >= jaccard.shared((percent * sizes + 99) // 100, percent).max()


def kept_tables(monkeypatch):
    tables, keep = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name="table": tables.setdefault(name, keep(frame, name)))
    return tables


def test_a_few_common_shingles_make_no_cell(spark, monkeypatch):
    """Documents that have one run of six words each in common with others, and no partner, are in no cell."""
    tables = kept_tables(monkeypatch)
    rng = random.Random(10)
    word = lambda: str(rng.randrange(10**9))
    runs = [[word() for _ in range(6)] for _ in range(40)]
    rows = [(i, [word() for _ in range(60)] + runs[i % 40] + [word() for _ in range(200)]) for i in range(160)]
    rows += [(500 + i, ["changed", *w[1:]]) for i, w in rows[:3]]
    found = jaccard.jaccard_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 500 for i, _ in rows}
    assert {r.doc for r in tables["cells"].select("doc").collect()} == {0, 1, 2, 500, 501, 502}


def test_few_unwanted_texts_move(spark):
    rows = spark.range(-50, 20_000).selectExpr("id as doc", "cast(id as string) as text")
    for step, most in ((997, 25), (3, 8000)):
        wanted = spark.range(-50, 20_000, step).selectExpr("id as doc")
        got = {r.doc for r in jaccard._about(rows, wanted, 20_050).collect()}
        assert got >= set(range(-50, 20_000, step)) and len(got) <= most
    assert jaccard._about(rows, wanted.limit(0), 20_050).count() == 0
