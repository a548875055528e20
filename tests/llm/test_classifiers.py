"""Classifiers: held-out accuracy, and the parts that have a brute-force form."""

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import ftrl, languages, neighbours, queries

DIR = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (None, "!!! ---"), (900003, "x " * 30000), (900003, "twice")]


@pytest.fixture(scope="module")
def marks(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark, marks):
    got = queries.op5_ftrl_quality(spark, DIR).collect()
    own = [r for r in got if r.doc_id in marks]
    assert len(got) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == marks[r.doc_id].quality for r in own if r.held_out]) >= 0.97


def test_toxicity_on_held_out_rows(spark, marks):
    got = queries.op10_block_max_neighbours(spark, "/root/testdata/sf0.1").collect()
    marks = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    own = [(r.predicted, marks[r.doc_id].toxic) for r in got if r.doc_id in marks and r.held_out]
    assert len(got) == 10000 and all(r.predicted == (r.score >= 0.7) for r in got)
    clean, toxic = [p for p, t in own if not t], [p for p, t in own if t]
    assert np.mean(clean) <= 0.01 and np.mean(toxic) >= 0.75


def test_languages_on_held_out_rows(spark):
    got = queries.op7_language_mixtures(spark, DIR).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(got) == 1000 and np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) >= 0.99


def test_odd_rows_and_nothing(spark):
    docs = spark.createDataFrame([(i, x, None) for i, x in ODD], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as y", "3 as held_out")
    labels = spark.createDataFrame([(None, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in ftrl.quality_scores(docs, labels).where("score = 0.5 and predicted = 1").collect()) == sorted(str(i) for i, _ in ODD)
    assert neighbours.toxicity(docs, labels).where("score = 0 and predicted = 0").count() == len(ODD)
    assert languages.language_mixtures(docs).where("lang_pred = 'und' and score = 0").count() == len(ODD)
    known = docs.withColumn("lang", docs["doc_id"].cast("string"))
    found = {(r.doc_id, r.lang_pred) for r in languages.language_mixtures(known.where("doc_id is not null")).collect()}
    assert {(900001, "und"), (900002, "und")} <= found
    for f in (lambda d: ftrl.quality_scores(d, labels), lambda d: neighbours.toxicity(d, labels), languages.language_mixtures):
        assert f(docs.limit(0)).count() == 0


def test_mixture_is_the_likeliest():
    """Expectation-maximisation against a fine grid of proportions of two languages."""
    rng = np.random.default_rng(0)
    sizes = [1, 3, 40, 200]
    like = rng.normal(-8, 2, (sum(sizes), 2)).astype(np.float32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    share, total = languages.mixture(like, at, np.ones((4, 2)), steps=2000)
    grid = np.linspace(1e-4, 1 - 1e-4, 4001)
    for i, (a, b) in enumerate(zip(at, at[1:])):
        p = np.exp(like[a:b].astype(float))
        value = np.log(p[:, :1] * grid + p[:, 1:] * (1 - grid)).sum(0) + languages.PRIOR * (np.log(grid) + np.log(1 - grid))
        assert abs(grid[value.argmax()] - share[i, 0]) < 0.02
        assert abs(np.log(p @ share[i]).sum() - total[i]) < 1e-2


def test_two_languages_in_one_text():
    table = np.full((1 << languages.BITS, 3), -12.0, np.float32)
    vocab = pa.array(["aaa", "bbb", "ccc"])
    buckets, at = languages.word_grams(vocab)
    for lang in range(3):
        table[buckets[at[lang] : at[lang + 1]], lang] = -1
    each = np.add.reduceat(table[buckets], at[:-1])
    share = languages.identify(each[np.array([0] * 30 + [1] * 20 + [2] * 9)], np.array([0, 50, 59]))
    assert abs(share[0, 0] - 0.6) < 0.02 and share[0, 2] == 0 and share[1, 2] == 1


@pytest.mark.parametrize("seed", range(5))
def test_blocks_give_the_exact_nearest(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.random((300, 40)) * (rng.random((300, 40)) < 0.15)
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-9)
    index = neighbours.Index(np.arange(40, dtype=np.uint64), np.ones(40), vectors, rng.integers(0, 2, 300), np.arange(300))
    for _ in range(40):
        term = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        q = index.weigh(term, rng.integers(1, 5, len(term)))
        cosine = vectors[:, term] @ q
        want = [i for i in np.lexsort((np.arange(300), -cosine)) if cosine[i] > 0][:15]
        found, got = index.nearest(term, q, 15)
        assert np.allclose(got, cosine[want]) and np.allclose(cosine[found], cosine[want])


def test_learner_weights():
    """One proximal step by hand, and that it learns."""
    learner = ftrl.Learner(3)
    learner.learn(np.array([0, 2]), np.array([1.0, 2.0]), 1)
    assert np.allclose(learner.z, [-0.5, 0, -1.0]) and np.allclose(learner.n, [0.25, 0, 1.0])
    assert np.allclose(learner.weights(slice(None)), [(0.5 - ftrl.L1) / ((ftrl.BETA + 0.5) / ftrl.ALPHA + ftrl.L2), 0, (1 - ftrl.L1) / ((ftrl.BETA + 1) / ftrl.ALPHA + ftrl.L2)])
    rng = random.Random(1)
    for _ in range(300):
        y = rng.randint(0, 1)
        learner.learn(np.array([y, 2]), np.array([1.0, 1.0]), y)
    w = learner.weights(slice(None))
    assert w[1] + w[2] > 1 and w[0] + w[2] < -1


def test_shapes():
    assert [ftrl.shape(w) for w in ("Thnd***", "LEEUX!!", "ab-12.5", "Éa", "a", "|")] == ["Ba**", "A!!", "a-0.0", "Ba", "a", "|"]


def test_search_goes_over_whole_vectors():
    """Rare terms in lists and common ones in dense rows, against all cosines; the index has each term of the examples."""
    rng = np.random.default_rng(7)
    vectors = rng.random((900, 400)) * (rng.random((900, 400)) < np.geomspace(0.001, 0.5, 400))
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-9)
    index = neighbours.Index(np.arange(400, dtype=np.uint64), np.ones(400), vectors, rng.integers(0, 2, 900), np.arange(900))
    assert 0 < len(index.often) < 400 and len(index.weight) > 0
    index = pickle.loads(pickle.dumps(index))  # as a worker has it
    for i in range(60):
        term = np.sort(rng.choice(400 if i % 2 else 150, rng.integers(1, 80), replace=False))
        q = index.weigh(term, rng.integers(1, 5, len(term)))
        cosine = vectors[:, term] @ q
        cosine[i] = 0
        want = [j for j in np.lexsort((np.arange(900), -cosine)) if cosine[j] > 0][:15]
        found, got = index.nearest(term, q, 15, skip=i)
        assert len(found) == len(want) and i not in found and np.allclose(got, cosine[want], atol=1e-6) and np.allclose(cosine[found], cosine[want], atol=1e-6)


def test_toxic_index_keeps_every_term(spark):
    """A text whose words are rare among marked examples, and a clean one, have neighbours; only copies verified at 0.8 go."""
    rng = random.Random(3)
    words = [f"w{i}q" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(300)]
    ids = [i for i in range(10_000) if not held(i)][:302]
    texts += [texts[0] + " tail", " ".join(texts[1].split()[:20] + ["zeppelinous"])]  # a near copy; half a text
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 10 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    index = neighbours.train(docs, labels)
    every = neighbours.counts(pa.array(texts[:300] + texts[301:]))[1]
    assert set(index.vocabulary.tolist()) == set(every.tolist())
    assert sorted(index.ids.tolist()) == sorted(set(ids) - {ids[300]})
    got = neighbours.score(spark.createDataFrame([(-1, "zeppelinous w1q")], "doc_id long, text string"), index).first()
    assert got.evidence[0].doc_id == ids[301]


def test_copies_by_brute_force():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 5000, 60).astype(np.uint32)) for _ in range(20)]
    sets = [np.unique(np.append(b[rng.random(len(b)) < keep], rng.integers(0, 5000, 3).astype(np.uint32))) for b in base for keep in (1, 0.95, 0.9, 0.85, 0.8, 0.7)]
    sets += [np.zeros(0, np.uint32)] * 2
    stay: list[int] = []
    for i, x in enumerate(sets):
        like = lambda j: 100 * len(np.intersect1d(x, sets[j])) >= 80 * len(np.union1d(x, sets[j]))
        if not any(len(x) and like(j) for j in stay):
            stay.append(i)
    assert neighbours.distinct(sets).tolist() == stay and len(stay) < len(sets)
