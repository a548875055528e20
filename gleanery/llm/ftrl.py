"""A quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are taken twice, as they read (folded, digits as 0) and as their shape
(runs of capitals, small letters and digits as one sign each, other signs as
they are): one- and two-word grams of the first, one- to three-word grams of
the second, and whether a three-word gram has stood in the text before.  A
feature's value is its share of the document's words, so a score is one sparse
dot product whatever the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import examples, held_out

#: Labelled rows to learn from, at most about; shards that learn apart and are averaged; passes of each over its rows.
ROWS, SHARDS, EPOCHS = 20_000, 8, 4
#: Buckets of the feature hash; scale of the values; the regularised leader's constants.
BITS, SCALE, ALPHA, BETA, L1, L2 = 18, 8.0, 0.5, 1.0, 0.02, 0.05
_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]{2,})|([A-ZÀ-ÖØ-Þ])|([^\W\d_A-ZÀ-ÖØ-Þ]+)|(\d+)|(\W)\5+")


def shape(word: str) -> str:
    """A, B, a, 0 for a run of capitals, one capital, small letters, digits; of a run of one sign two stay."""
    return _RUNS.sub(lambda m: m[5] * 2 if m[5] else "ABa0"[m.lastindex - 1], word)


def grams(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of each gram that starts at each word, by template (-1 where it leaves the text); offsets of the texts."""
    codes, offsets, vocab = tk.words(text)
    raw = vocab.to_pylist()
    h = xxhash.xxh3_64_intdigest
    plain = np.fromiter((h(re.sub(r"\d", "0", w.lower()).encode()) for w in raw), np.uint64, len(raw))[codes]
    forms = np.fromiter((h(shape(w).encode(), 7) for w in raw), np.uint64, len(raw))[codes]
    out = []
    for base, sizes in ((plain, (1, 2)), (forms, (1, 2, 3))):
        for k in sizes:
            at = np.full(len(codes), -1, np.int64)
            inside, _ = tk.window_docs(offsets, k, len(codes))
            at[: len(inside)][inside] = (tk.rolling(base, k)[inside] * np.uint64(2 * k + 1) >> np.uint64(64 - BITS)).astype(np.int64)
            out.append(at)
    # whether the three words from here have stood in the text before
    again = np.full(len(codes), -1, np.int64)
    inside, doc = tk.window_docs(offsets, 3, len(codes))
    at = np.flatnonzero(inside)
    if len(at):
        three = tk.rolling(plain, 3)[at]
        order = np.lexsort((three, doc[at]))
        same = (three[order][1:] == three[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        again[at] = 0
        again[at[order[1:][same]]] = 1
    out.append(again)
    return out, offsets


class Learner:
    """Follow the regularised leader, proximal: a weight is nothing until its gradients add up to more than L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _fit(batches: Iterable[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for part in tk.slices(batches):
        at, offsets = grams(part.column("text"))
        for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
            own, times = np.unique(np.concatenate([t[a:b] for t in at]), return_counts=True)
            times = times[own >= 0] * (SCALE / max(b - a, 1))
            rows.append((part.column("doc_id")[i].as_py(), np.append(own[own >= 0], 1 << BITS), np.append(times, 1.0), part.column("y")[i].as_py()))
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))  # an order of its own, whatever came first
    learner = Learner((1 << BITS) + 1)
    for _ in range(epochs):
        for _, at, x, y in rows:
            learner.learn(at, x, y)
    w = learner.weights(slice(None)).astype("<f4")
    yield pa.RecordBatch.from_pylist([{"n": len(rows), "w": w.tobytes()}], pa.schema([("n", pa.int64()), ("w", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> np.ndarray:
    """Weights by bucket, the last of a constant: the shards' weights averaged by their rows. No labelled rows: all 0."""
    taken = examples(docs, labels, label, rows).repartition(SHARDS, F.xxhash64("doc_id", F.lit("shard")))
    found = taken.mapInArrow(lambda b: _fit(b, EPOCHS), "n long, w binary").where("n > 0").collect()
    total = sum(r.n for r in found)
    out = np.zeros((1 << BITS) + 1, np.float32)
    for r in found:
        out += np.frombuffer(r.w, "<f4") * np.float32(r.n / total)
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score of every whole text; a null or empty one has the constant's score."""
    sent = docs.sparkSession.sparkContext.broadcast(np.append(weights[:-1], [0, weights[-1]]).astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value  # place -2 is the weight of no gram
        for part in tk.slices(batches):
            at, offsets = grams(part.column("text"))
            each = sum((w[np.where(t < 0, 1 << BITS, t)].astype(np.float64) for t in at), np.zeros(len(at[0])))
            total = np.concatenate([[0.0], np.cumsum(each)])[offsets]
            margin = np.diff(total) * (SCALE / np.maximum(np.diff(offsets), 1)) + w[-1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5).

    Learns from ``rows`` labelled documents at most, held-out ones never.  Null
    and empty texts score as the constant says, null and repeated doc_ids are
    kept as they are, other columns are left out, no labels give 0.5.
    """
    return score(docs, train(docs, labels, "quality", rows)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
