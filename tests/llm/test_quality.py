"""Quality rules against statistics and concentration steps written out."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import quality


def stats(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(lines), len(covered)


def brute(rows, cutoff=50.0, least=100):
    """Verdicts by plain numpy, groups cut at bins of the logarithm of the distance as documented."""
    own = [stats(x) for _, x, *_ in rows]
    failed = [n < 50 or 100 * r > 50 * n for n, *_, r in own]
    x = np.array([[math.log(1 + n), math.log(1 + c / n), math.log(1 + s / n), d / max(m, 1), r / n] if not f else [0] * 5 for (n, c, s, d, m, r), f in zip(own, failed)])
    floor = np.array([s for _, s in quality.STATISTICS.values()])
    groups = {}
    for i, (_, _, lang, source) in enumerate(rows):
        if not failed[i]:
            for g in ((0, lang, source), (1, lang), (2,)):
                groups.setdefault(g, []).append(i)
    found = {}
    for g, members in groups.items():
        y = x[members]
        # the start takes the observed value at a quantile's rank, as percentile_approx
        q = [np.sort(y, 0)[max(0, math.ceil(p * len(y)) - 1)] for p in (0.25, 0.5, 0.75)]
        scale = np.maximum((q[2] - q[0]) / 1.349, floor)
        z = (y - q[1]) / scale
        spread = lambda v: np.cov(v.T, bias=True) * np.outer(scale, scale) + np.diag(floor**2)  # noqa: E731, B023
        ends = []
        for start, cov in enumerate((np.diag(scale**2), spread(np.tanh(z)), spread(z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]))):
            mean, least_log = q[1], math.inf
            while True:
                d = np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
                bins = np.floor(np.log(d + 1e-6) * 16)
                near = y[bins <= np.sort(bins)[math.ceil(0.75 * len(y)) - 1]]
                to = near.mean(0), np.cov(near.T, bias=True) * quality.CONSISTENT + np.diag(floor**2)
                if (log := np.linalg.slogdet(to[1])[1]) >= least_log - quality.GAIN:
                    break
                (mean, cov), least_log = to, log
            ends.append((least_log, start, mean, cov))
        _, _, mean, cov = min(ends, key=lambda e: e[:2])
        found[g] = mean, cov, len(members)
    out = []
    for i, (_, _, lang, source) in enumerate(rows):
        kept = not failed[i]
        g = next((g for g in ((0, lang, source), (1, lang), (2,)) if kept and g in found and found[g][2] >= least), None)
        if g:
            mean, cov, _ = found[g]
            kept = bool((x[i] - mean) @ np.linalg.inv(cov) @ (x[i] - mean) <= cutoff)
        out.append((own[i], failed[i], kept))
    return out


def corpus(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(30, 250))]
        if rng.random() < 0.08:
            words = [w + rng.choice(["###", "***"]) for w in words]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t"]) for w in words)
        if rng.random() < 0.2:
            text += "\n" + "\n".join([text.split("\n")[0]] * rng.randint(1, 4))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None])))
    return rows + [(900, None, "en", "a"), (901, "", "en", "a"), (902, "a b " * 200, "xx", "z"), (903, "### " * 3 + " ".join(f"q{i}" for i in range(60)), "xx", "q"), (903, " \n\x0b\n \n", None, None)]


@pytest.mark.parametrize("most", [20_000, 1])
def test_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", most)
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as level").repartition(3)
    for least in (30,) if most == 1 else (100, 30):
        want = Counter(((i, n, c, s, d, m, r), failed, kept) for (i, *_), ((n, c, s, d, m, r), failed, kept) in zip(rows, brute(rows, least=least)))
        got = Counter(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words), r.base_failed, r.kept) for r in quality.quality_rules(docs, least_rows=least).collect())
        assert got == want


def test_the_least_determinant_wins(spark):
    """No start ends below the estimate that is taken; most of a group being junk of another kind, searches end apart."""
    rng = random.Random(4)
    rows = [(rng.gauss(6, 0.3), rng.gauss(1.7, 0.05), abs(rng.gauss(0, 0.01)), 0.0, abs(rng.gauss(0.1, 0.03)), "en", "a") for _ in range(200)]
    rows += [(rng.gauss(3, 0.1), rng.gauss(2.5, 0.01), 1 + rng.gauss(0, 0.01), 0.5, 0.3, "en", "a") for _ in range(60)]
    frame = spark.createDataFrame(rows, [*quality.STATISTICS, "lang", "source"]).selectExpr("0 as level", "lang", "source", *quality.STATISTICS)
    ends = quality.searches(frame).collect()
    assert {r.start for r in ends} == {0, 1, 2}
    best = min(ends, key=lambda r: (r.logdet, r.start))
    assert best.n == 260 and abs(best.m0 - 6) < 0.1 and abs(best.m2) < 0.05


def test_a_very_long_text(spark):
    words = [f"w{i % 5000}x{i}" for i in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a"), (2, " ".join(["same"] * 100_000), "en", "a")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (120_000, 0, True)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].kept) == (100_000, 100_000, False)


def test_nothing_and_few(spark):
    docs = spark.createDataFrame([(None, " ".join(f"q{i}" for i in range(60)), None, None)] * 2, "doc_id long, text string, lang string, source string")
    assert [(r.doc_id, r.kept, r.distance) for r in quality.quality_rules(docs).collect()] == [(None, True, None)] * 2
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_labels(spark):
    """On the whole small table: marked texts go, good ones stay."""
    from gleanery.llm import queries

    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op4_robust_outlier_rules(spark, "/root/testdata/sf0.01").collect()
    good = [r.kept for r in got if marks.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if marks.get(r.doc_id) == 0]
    assert len(got) == 1000 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
