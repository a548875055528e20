"""Ranked lexical search: term at a time with limited accumulators.

Documents are indexed in slices, by the terms that the queries hold.  Inside a
slice a query's terms come rarest first; a document gets an accumulator with
its first term.  Once what is left of the terms can't lift a new document to
the kth best partial score, no more accumulators are made, and those that
still can reach it are brought to their exact scores.  A task carries its best
scores from slice to slice, so that later slices stop earlier; the best of all
tasks are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, storage
from . import textkit as tk

#: Bytes of text of a slice; terms of a block of queries.
SLICE, BLOCK = 16 << 20, 400_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII that is in no term becomes a blank, A-Z become small; other bytes are parts of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "documents long, all_terms long, ids array<long>, lengths binary, terms array<int>, holders array<long>, places binary, counts binary"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _sliced(vocab, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows: of a slice's documents that hold a term of the vocabulary their ids and lengths, of every such term the documents and counts."""
    get = vocab.value.get
    for part in tk.merged(batches, limit=SLICE):
        texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
        codes, sizes, documents = [], np.zeros(len(texts), np.int64), 0
        for i, text in enumerate(texts):
            found = text.translate(_FOLD).split()
            sizes[i] = len(found)
            codes.append(np.fromiter(map(get, found, repeat(-1)), np.int32, len(found)))
        flat, doc = np.concatenate(codes), np.repeat(np.arange(len(texts)), sizes)
        doc, flat = doc[flat >= 0], flat[flat >= 0].astype(np.int64)
        held, doc = np.unique(doc, return_inverse=True)
        pairs, counts = np.unique(flat * len(texts) + doc, return_counts=True)
        own, first = np.unique(pairs // len(texts), return_index=True)
        row = {
            "documents": int((sizes > 0).sum()),
            "all_terms": int(sizes.sum()),
            "ids": part.column("doc_id").take(pa.array(held)).to_pylist(),
            "lengths": sizes[held].astype("<i8").tobytes(),
            "terms": own.tolist(),
            "holders": np.diff(np.append(first, len(pairs))).tolist(),
            "places": (pairs % len(texts)).astype("<i4").tobytes(),
            "counts": counts.astype("<i8").tobytes(),
        }
        kinds = {"documents": pa.int64(), "all_terms": pa.int64(), "ids": pa.list_(pa.int64()), "terms": pa.list_(pa.int32()), "holders": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The slices of doc_id, text under the terms of the vocabulary, as a written table."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return storage.written(rows.mapInArrow(lambda batches: _sliced(sent, batches), INDEX), "postings")


def weight(documents: int, holders: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holders + 1)))


def damped(lengths: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """100 - 90 + 90 n N div L of each length, in whole numbers of any size."""
    some, back = np.unique(lengths, return_inverse=True)
    return np.array([10 + 90 * n * documents // all_terms for n in some.tolist()], np.int64)[back]


class Postings:
    """A slice with the scores that each term gives its documents."""

    def __init__(self, row: dict, weights: dict[int, int], documents: int, all_terms: int):
        self.ids, lengths = row["ids"], np.frombuffer(row["lengths"], "<i8")
        m = damped(lengths, documents, all_terms) if len(lengths) else lengths
        places, counts = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["counts"], "<i8")
        part = 1_000_000_000 * counts // (1000 * counts + 8 * m[places])
        ends = np.cumsum(row["holders"]).tolist()
        self.lists = {}
        for t, a, b in zip(row["terms"], [0, *ends], ends):
            scores = weights[t] * part[a:b]
            self.lists[t] = (places[a:b], scores, int(scores.max()))
        #: Accumulators made, for tests.
        self.made = 0

    def best(self, query: list[int], k: int, reached: int = 0) -> list[tuple[int, int]]:
        """Of the query's terms, rarest first, the k best (score, place), by whole scores; those under ``reached`` may be left out."""
        lists = [self.lists[t] for t in query if t in self.lists]
        rest = np.cumsum([0, *(x[2] for x in reversed(lists))])[::-1].tolist()  # of this term and all after it
        sums, kth, live = np.zeros(len(self.ids), np.int64), reached, None
        for i, (places, scores, _) in enumerate(lists):
            if live is None and rest[i] < kth:  # no new document can get there: those that can go on
                live = np.flatnonzero(sums)
                self.made += len(live)
            if live is None:
                sums[places] += scores
                some = sums[sums > 0]
            else:
                live = live[sums[live] + rest[i] >= kth]
                if not len(live):
                    break
                at = np.minimum(np.searchsorted(places, live), len(places) - 1)
                hit = places[at] == live
                sums[live[hit]] += scores[at[hit]]
                some = sums[live]
            if len(some) >= k:
                kth = max(kth, int(np.partition(some, len(some) - k)[len(some) - k]))
        if live is None:
            live = np.flatnonzero(sums)
            self.made += len(live)
        live = live[(sums[live] > 0) & (sums[live] >= kth)]
        return list(zip(sums[live].tolist(), live.tolist()))


def _order(found: tuple[int, int | None]) -> tuple:
    score, doc = found
    return -score, doc is None, doc or 0


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for every item the k documents of greatest score above 0, equal scores by ascending doc_id.

    docs has doc_id, text; items has item_id, text.  Null and termless texts
    score nothing and find nothing.  Rows of docs that share a doc_id are
    documents of their own, a null doc_id comes after others of its score;
    rows of items are items of their own, whatever their item_id.  Items come
    in blocks of about BLOCK terms, each with one index of the documents.
    """
    spark = docs.sparkSession
    folded = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), 0)).alias("terms")).where(F.size("terms") > 0)
    found = None
    for block in blocks.dealt(asked.withColumn("size", F.size("terms")), BLOCK, "size"):
        rows = block.select(["item_id", "terms"]).to_pylist()
        vocabulary = {t.encode(): i for i, t in enumerate(dict.fromkeys(t for r in rows for t in r["terms"]))}
        postings = index(docs, vocabulary)
        whole = postings.agg(F.sum("documents"), F.sum("all_terms")).head()
        if not whole[0]:
            continue
        held = postings.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy("x.terms").agg(F.sum("x.holders").alias("n"))
        holders = {r["terms"]: r["n"] for r in held.toLocalIterator()}  # as many as the block's terms
        weights = {t: weight(whole[0], n) for t, n in holders.items()}
        queries = [sorted((t for x in r["terms"] if weights.get(t := vocabulary[x.encode()])), key=lambda t: (holders[t], t)) for r in rows]
        sent = spark.sparkContext.broadcast((queries, weights, whole[0], whole[1]))

        def score(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, weights, documents, all_terms = sent.value
            best: list[list[tuple[int, int | None]]] = [[] for _ in queries]
            for batch in batches:
                for i in range(batch.num_rows):
                    part = Postings(batch.slice(i, 1).to_pylist()[0], weights, documents, all_terms)
                    for q, query in enumerate(queries):
                        reached = best[q][-1][0] if len(best[q]) == k else 0
                        if new := part.best(query, k, reached):
                            best[q] = sorted([*best[q], *((s, part.ids[at]) for s, at in new)], key=_order)[:k]
            out = [(q, doc, s) for q, own in enumerate(best) for s, doc in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"item long, item_id {dict(items.dtypes)['item_id']}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = postings.mapInArrow(score, "item long, doc_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        more = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return found
