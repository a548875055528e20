"""Scores of whole texts by the classifiers against plain loops over their words."""

import collections
import math
import random
import re
import zlib

import numpy as np
import xxhash

from gleanery.llm import ftrl, languages, neighbours
from gleanery.llm import textkit as tk


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def texts(seed, n, vocabulary=120, most=50):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aBcdé1-*Ő") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_quality_is_a_sum_over_grams(spark):
    rng = np.random.default_rng(0)
    weights = (rng.standard_normal((1 << ftrl.BITS) + 1) / 20).astype(np.float32)
    rows = [(i, t) for i, t in enumerate([*texts(1, 40), None, "", "one", "a b a b a b a b", "x " * 4000])]

    def bucket(hashes, k):
        return int(tk.rolling(np.array(hashes, np.uint64), k)[0] * np.uint64(2 * k + 1) >> np.uint64(64 - ftrl.BITS))

    def plain(text):
        own = split(text)
        lower = [xxhash.xxh3_64_intdigest(re.sub(r"\d", "0", w.lower()).encode()) for w in own]
        forms = [xxhash.xxh3_64_intdigest(ftrl.shape(w).encode(), 7) for w in own]
        total, seen = 0.0, set()
        for i in range(len(own)):
            for base, sizes in ((lower, (1, 2)), (forms, (1, 2, 3))):
                total += sum(float(weights[bucket(base[i : i + k], k)]) for k in sizes if i + k <= len(own))
            if i + 3 <= len(own):
                three = tuple(lower[i : i + 3])
                total += float(weights[1 if three in seen else 0])
                seen.add(three)
        return 1 / (1 + math.exp(-(total * ftrl.SCALE / max(len(own), 1) + float(weights[-1]))))

    got = {r.doc_id: r.score for r in ftrl.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), weights).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-6 for i, t in rows)


def test_a_score_at_the_threshold_is_a_mark(spark):
    docs = spark.createDataFrame([(1, "word"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in ftrl.quality_scores(docs, labels).collect()] == [(0.5, 1)] * 2


def test_language_counts_and_proportions(spark):
    """Counts by a plain loop over learning rows; each text by the sums of its words' grams."""
    rng = random.Random(2)
    alphabets = {"p": "abcdé", "q": "bcdefg", "r": "xyzñ"}
    make = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 7))) + rng.choice(["", ",", "7"]) for _ in range(n))
    rows = [(i, make(lang := rng.choice("pqr"), rng.randint(1, 40)) + (" " + make(rng.choice("pqr"), 30) if i % 4 == 0 else ""), lang if i % 9 else None) for i in range(90)]
    rows += [(900, "123 --- 4", "p"), (901, None, "q"), (902, "", "r"), (None, make("r", 9), "r")]

    def grams(word):
        bare = "".join(c for c in word if c.isalpha()).lower()
        raw = f"^{bare}$".encode() if bare else b""
        return [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - languages.BITS) for i in range(len(raw) - 2)]

    counts = collections.Counter((lang, b) for i, t, lang in rows if lang and (i is None or not held(i)) for w in split(t) for b in grams(w))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    names, table = languages.train(df)
    want = np.full((1 << languages.BITS, len(names)), languages.PSEUDO)
    for (lang, b), n in counts.items():
        want[b, names.index(lang)] += n
    want = np.log(want / want.sum(0))
    assert names == ["p", "q", "r"] and np.allclose(table, want, atol=1e-5)
    found = {r.doc_id: (r.lang_pred, r.score) for r in languages.language_mixtures(df).collect()}
    for i, t, _ in rows:
        like = np.array([table[grams(w)].astype(float).sum(0) for w in split(t) if grams(w)], np.float32).reshape(-1, len(names))
        if not len(like):
            assert found[i] == ("und", 0.0)
            continue
        share = languages.identify(like, np.array([0, len(like)]))[0]
        assert found[i][0] == names[int(share.argmax())] and abs(found[i][1] - min(1.0, share.max())) < 1e-3


def test_equal_proportions_go_to_the_first_language():
    like = np.array([[-1.0, -9.0], [-9.0, -1.0]] * 40, np.float32)
    share = languages.identify(like, np.array([0, 80]))[0]
    assert abs(share[0] - share[1]) < 1e-6 and int(share.argmax()) in (0, 1)
    assert (languages.identify(like[:, ::-1].copy(), np.array([0, 80]))[0].argmax() == 0) == (share[::-1].argmax() == 0)


def terms(text):
    out = collections.Counter()
    for w in split(text):
        bare = w.lower().strip(neighbours.SIGNS)
        if bare:
            out["w", bare] += 1
            for k in neighbours.FIRST:
                if len(bare) > k:
                    out["p", bare[:k]] += 1
    return out


def test_toxicity_from_plain_cosines(spark):
    """Vectors, neighbours, votes and calibration of real text lengths by dictionaries."""
    own = [i for i in range(2000) if not held(i)][:160]
    told = {i: t for i, t in zip(own, texts(5, 160, vocabulary=90, most=60))}
    rng = random.Random(6)
    marked = {i: int(rng.random() < 0.3 or "Ő" in told[i][:20]) for i in own}
    docs = spark.createDataFrame(list(told.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(marked.items()), "doc_id long, toxic int")
    index = neighbours.train(docs, labels)
    kept = sorted(index.ids.tolist())
    assert len(kept) > 140  # near copies, among them all empty ones' like, may have gone
    found = {i: terms(told[i]) for i in kept}
    y = {i: marked[i] for i in kept}
    n1, n0 = sum(y.values()), len(kept) - sum(y.values())
    share, d = n1 / len(kept), {0: collections.Counter(), 1: collections.Counter()}
    for i in kept:
        d[y[i]].update(found[i].keys())
    weight = {}
    for t in d[0] | d[1]:
        a, b = d[1][t], d[0][t]
        more = (a + neighbours.PRIOR * share) / n1 / ((b + neighbours.PRIOR * (1 - share)) / n0)
        weight[t] = math.log((len(kept) + 1) / (a + b + 0.5)) * math.log2(2 + more)

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    vectors = {i: vector(c) for i, c in found.items()}

    def vote(v, skip=None):
        near = sorted(((sum(x * w.get(t, 0.0) for t, x in v.items()), i) for i, w in vectors.items() if i != skip), key=lambda s: -s[0])[: neighbours.NEAREST]
        return sum(c * (2 * y[i] - 1) for c, i in near if c > 0) / neighbours.NEAREST

    votes = np.array([vote(vectors[i], i) for i in kept])
    knots = neighbours._isotonic(votes, np.array([y[i] for i in kept], float))
    asked = texts(7, 25, vocabulary=90) + [told[own[3]], None, "", "unheard-of"]
    got = {r.doc_id: r.score for r in neighbours.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), index).collect()}
    assert np.allclose(index.knots[0], knots[0], atol=1e-5) and np.allclose(index.knots[1], knots[1], atol=1e-6)
    for i, t in enumerate(asked):
        v = vote(vector(terms(t)))
        near = np.interp([v - 1e-5, v + 1e-5], *index.knots)
        assert near[0] - 1e-6 <= got[i] <= near[1] + 1e-6


def test_equal_cosines_of_both_labels():
    """Of two like examples the one of the lesser place comes first, whatever its label; both vote."""
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    index = neighbours.Index(np.arange(2, dtype=np.uint64), np.ones(2), vectors, np.array([0, 1, 1]), np.array([5, 6, 7]))
    found, cosine = index.nearest(np.array([0]), index.weigh(np.array([0]), np.array([2])), 15)
    assert found.tolist() == [0, 1] and cosine.tolist() == [1.0, 1.0] and index.vote(found, cosine) == 0.0
    assert index.nearest(np.array([0]), np.ones(1), 1)[0].tolist() == [0]
