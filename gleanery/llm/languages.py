"""Languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

Each language has an n-gram model of its words.  A text is taken as words drawn
from several languages; expectation-maximisation estimates the proportions,
and of the sets of its k likeliest languages the one with the best penalised
likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import held_out

#: Buckets of byte 3-grams; pseudo-count of a bucket; steps of expectation-maximisation.
BITS, PSEUDO, STEPS = 16, 0.1, 12
#: Prior words of each language in a text; log-likelihood that one more language must bring, by the logarithm of the words.
PRIOR, PENALTY = 0.25, 2.0


def word_grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3-grams of each word's letters between marks, and their offsets; a word without letters has none."""
    bare = pc.utf8_lower(pc.replace_substring_regex(vocab.cast(pa.string()), r"[^\p{L}]+", ""))
    some = pc.greater(pc.binary_length(bare), 0)
    ends = pc.if_else(some, pc.binary_join_element_wise("^", bare, "$", ""), "").cast(pa.binary())
    at = np.frombuffer(ends.buffers()[1], np.int32)[ends.offset : ends.offset + len(ends) + 1].astype(np.int64)
    data = np.frombuffer(ends.buffers()[2] or b"", np.uint8)[at[0] if len(at) else 0 : at[-1] if len(at) else 0].astype(np.uint64)
    at = at - (at[0] if len(at) else 0)
    n = np.maximum(np.diff(at) - 2, 0)
    i = tk.gather(at[:-1], n)
    three = (data[i] << np.uint64(16)) | (data[i + 1] << np.uint64(8)) | data[i + 2] if len(i) else np.zeros(0, np.uint64)
    return (three * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each bucket in each. Counts cover all rows with a language that aren't held out."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in tk.slices(batches):
            codes, offsets, vocab = tk.words(part.column("text"))
            buckets, at = word_grams(vocab)
            names = part.column("lang").to_pylist()
            of = np.repeat(np.arange(len(names)), np.diff(offsets))
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            which = np.array([known[x] for x in names], np.int64)[of]
            for name, i in known.items():
                times = np.bincount(codes[which == i], minlength=len(vocab))
                own = np.bincount(buckets, weights=np.repeat(times, np.diff(at)), minlength=1 << BITS)
                sums[name] = sums.get(name, 0) + own
        for name, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(own[some].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    # a row for each language and bucket: bounded by the languages, whatever the corpus
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((1 << BITS, len(names)), PSEUDO)
    np.add.at(counts, (found["bucket"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)), found["n"].to_numpy(float))
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs; no run is empty."""
    return np.add.reduceat(values, at[:-1], axis=0)


def mixture(like: np.ndarray, at: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text, and its log-likelihood.

    like: log-likelihoods of words by language; at: offsets of texts of a word
    or more; allowed: the languages that each text may have.
    """
    n = np.diff(at)
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    share = allowed / allowed.sum(1, keepdims=True)
    prior = PRIOR * allowed
    for _ in range(steps):
        r = p * np.repeat(share, n, 0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        new = _sum(r, at) + prior
        new /= new.sum(1, keepdims=True)
        if np.abs(new - share).max(initial=0) < 1e-4:
            share = new
            break
        share = new
    total = np.log(np.maximum((p * np.repeat(share, n, 0)).sum(1), 1e-30)) + top[:, 0]
    return share, _sum(total, at)


def identify(like: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Proportions of each text over the set of languages with the best penalised likelihood."""
    n = np.diff(at)
    langs = like.shape[1]
    share, _ = mixture(like, at, np.ones((len(n), langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    best, chosen = np.full(len(n), -np.inf), share.copy()
    live = np.arange(len(n))
    for k in range(1, langs + 1):
        if not len(live):
            break
        own = tk.gather(at[:-1][live], n[live])
        ends = np.concatenate([[0], np.cumsum(n[live])])
        s, total = mixture(like[own], ends, (rank[live] < k).astype(float), STEPS if k > 1 else 1)
        value = total - PENALTY * (k - 1) * np.log(n[live] + 1)
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], s[better]
        # a further language is tried while the last one brought something and the next has a word's share
        nxt = np.take_along_axis(share, order[:, k : k + 1], 1)[:, 0] if k < langs else np.zeros(len(n))
        live = live[better & (nxt[live] * n[live] > 0.5)]
    return chosen


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (those of the kept set with their proportions)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches):
            codes, offsets, vocab = tk.words(part.column("text"))
            buckets, at = word_grams(vocab)
            k = len(names)
            sums = np.concatenate([np.zeros((1, k)), np.cumsum(sent.value[buckets].astype(np.float64), axis=0)]) if k else np.zeros((len(buckets) + 1, 0))
            each, some = (sums[at[1:]] - sums[at[:-1]]).astype(np.float32), np.diff(at) > 0
            keep = some[codes]
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            own = np.flatnonzero(np.diff(ends)) if k else np.zeros(0, np.int64)
            lang, score, mix = ["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1), [[] for _ in range(len(offsets) - 1)]
            if len(own):
                chosen = identify(each[codes[keep]], np.append(ends[own], ends[-1]))
                for i, p in zip(own.tolist(), chosen):
                    j = int(p.argmax())
                    lang[i], score[i] = names[j], min(1.0, float(p[j]))
                    mix[i] = [{"lang": names[x], "share": float(p[x])} for x in np.argsort(-p) if p[x] > 0]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def language_mixtures(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (proportion of lang_pred), languages.

    docs: doc_id, text, lang; other columns are left out.  ``und`` with score 0
    where the text is null or has no letter, or where no row has a language to
    learn from.  Repeated rows and null doc_ids are kept; no rows give none.
    """
    return predict(docs, *train(docs))
