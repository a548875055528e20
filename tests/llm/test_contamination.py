"""Containment search against all pairs."""

import random

from gleanery.llm import contamination


def shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"W{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 30, 70])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, items[0][1]), (None, items[5][1]), (103, "a b c d e f")]
    docs = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            text[len(text) // 2 : len(text) // 2] = own[: rng.randint(len(own) * 3 // 4, len(own))]
        docs.append((i, " \n"[rng.random() < 0.5].join(text).lower()))
    docs += [(200, None), (201, ""), (None, items[5][1]), (202, items[0][1]), (3, items[7][1])]
    found = {}
    for d, x in docs:
        for i, y in items:
            a, b = shingles(x), shingles(y)
            if b and 100 * len(a & b) >= 80 * len(b):
                found[d, i] = max(found.get((d, i), (0, 0)), (len(b), len(a & b)))
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as id", "3 as hash")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as n")
    got = contamination.contamination(left, right).collect()
    assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == found and len(got) == len(found)
    assert contamination.contamination(left, right.limit(0)).count() == contamination.contamination(left.limit(0), right).count() == 0


def test_a_very_long_document(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    items = [(1, " ".join(words[50_000:50_020])), (2, " ".join(words[99_000:99_400])), (3, " ".join(f"n{i}" for i in range(20)))]
    docs = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:300]))], "doc_id long, text string")
    got = contamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got) == [(7, 1, 16, 16), (7, 2, 396, 396)]
