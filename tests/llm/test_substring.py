"""Substring dedup against a brute-force reading of its rule."""

import hashlib
import random

import pytest

from gleanery.llm import substring


def brute(rows, window):
    """(doc_id, kept words) by the rule itself."""
    first, out = {}, {}
    docs = sorted(((-1 if i is None else i), (x or "").encode().split()) for i, x in rows)
    for i, words in docs:
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (i, s))
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("window,seed", [(20, 0), (20, 1), (5, 2), (2, 3), (40, 4)])
def test_against_brute_force(spark, window, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(window // 2, 3 * window))] for _ in range(5)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(100, None), (101, ""), (None, " ".join(passages[0] * 2)), (102, "a " * 300), (103, "é\x1cx " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as marks", "'y' as n_words").repartition(3)
    want = brute(rows, window)
    got = substring.substring_dedup(docs, window).collect()
    assert len(got) == len(rows)
    by = dict(((-1 if i is None else i), x) for i, x in rows)
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        n = len((by[i] or "").encode().split())
        assert r.text == b" ".join(want[i]).decode(), i
        assert (r.n_words, r.n_removed) == (n, n - len(want[i])) and r.n_removed == sum(s.end - s.start for s in r.spans)


def test_repeated_rows_and_nothing(spark):
    text = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring.substring_dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_covers_have_every_difference():
    for v, d in substring.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_query_on_whole_table(spark):
    from gleanery.llm import queries

    got = queries.op2_difference_cover_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute(rows, 20)
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(b" ".join(w)).hexdigest() for i, w in want.items()}
