"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first letters of longer words, all terms of all
examples; a term's weight is TF-IDF times its relevance frequency, 1 or more,
which grows with how much more frequent the term is in examples with the mark.
Examples stand in blocks.  A term in many examples is a row of a dense matrix;
another's list has its weights and, per block, the greatest of them.  A query
opens blocks by their bound, the most that the dense rows give in the block and
the summed products with those greatest weights, and stops when no closed block
can hold one of the k nearest, so its neighbours are the exact ones.  Votes,
weighted by cosine, are calibrated on the examples, each held against all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import examples, held_out
from .storage import written

#: Labelled rows to learn from, at most about; neighbours that vote; examples of a block; so many first letters are terms.
ROWS, NEAREST, BLOCK, FIRST = 8_000, 15, 512, (4, 5, 6, 7, 8)
#: So many terms at most, each in this share of the examples or more, are dense rows; blocks opened before the bound is looked at; queries of a matrix product.
DENSE, DENSE_SHARE, FIRST_BLOCKS, BATCH = 2_048, 0.01, 4, 256
#: Cases at the base rate that are added to a term's counts; per cent of the union of their five-word shingles that near copies share.
PRIOR, COPY = 5.0, 80
#: What a bound may be off by, as may single-precision weights.
MARGIN = 1e-6
PREDICT = 0.7
#: Signs that don't count at a word's ends.
SIGNS = "#*$%&|<>.,;:!?\"'()[]{}-_=+/\\~`^@…»«“”„’‘¡¿"


def terms(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of each distinct word, and their offsets: folded, without signs at the ends; its first letters."""
    h = xxhash.xxh3_64_intdigest
    words = pc.utf8_trim(pc.utf8_lower(vocab.cast(pa.string())), characters=SIGNS)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out, has = np.zeros((len(words), 1 + len(FIRST)), np.uint64), np.zeros((len(words), 1 + len(FIRST)), bool)
    for i, k in enumerate((0, *FIRST)):
        own = has[:, i] = length > k
        # many words have the same first letters: each is hashed once
        coded = (pc.utf8_slice_codeunits(words.filter(pa.array(own)), 0, k) if k else words.filter(pa.array(own))).dictionary_encode()
        each = np.fromiter((h(w, 1 if k else 0) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
        out[own, i] = each[coded.indices.to_numpy(zero_copy_only=False)]
    return out[has], np.concatenate([[0], np.cumsum(has.sum(1))])


def counts(text: pa.Array, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of each text; only terms in the sorted ``of``, then as places in it."""
    codes, offsets, vocab = tk.words(text)
    names, at = terms(vocab)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    known, place = (of, None) if of is not None else np.unique(names, return_inverse=True)
    if place is None:
        order = np.argsort(names)
        place = np.empty(len(names), np.int64)
        place[order] = np.searchsorted(known, names[order])  # in order, so that the search stays near
        good = known[np.minimum(place, len(known) - 1)] == names if len(known) else np.zeros(len(names), bool)
        at = np.concatenate([[0], np.cumsum(good)])[at]
        place = place[good]
    n = np.diff(at)[codes]
    some = n > 0
    codes, doc, n = codes[some], doc[some], n[some]
    both = np.sort(np.repeat(doc << 32, n) | place[tk.gather(at[codes], n)])
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    doc, place = both[first] >> 32, both[first] & 0xFFFFFFFF
    return doc, known[place] if of is None else place, np.diff(np.append(first, len(both)))


def _among(x: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Whether each of x, below n, is one of some."""
    mask = np.zeros(n, bool)
    mask[some] = True
    return mask[x]


class Index:
    """Examples as unit vectors over the vocabulary, in blocks; ``vectors`` are a matrix or (example, term, weight) by term, then by example.

    Without ``search`` it is there to be sent: whoever receives it sets up the
    blocks and dense rows.
    """

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, vectors: np.ndarray | tuple, y: np.ndarray, ids: np.ndarray, search: bool = True):
        self.vocabulary, self.idf, self.y, self.ids = vocabulary, idf, y, ids
        if not isinstance(vectors, tuple):
            term, example = np.nonzero(vectors.T)
            vectors = example, term, vectors[example, term]
        example, term, weight = vectors[0].astype(np.int32, copy=False), vectors[1], vectors[2].astype(np.float32, copy=False)
        n = np.bincount(term, minlength=len(vocabulary))
        self.sent = example.astype(np.uint16) if len(y) < 1 << 16 else example, n.astype(np.int32), weight
        self.knots: tuple[np.ndarray, np.ndarray] = np.zeros(1), np.zeros(1)
        self.shared: Broadcast | None = None
        if search:
            self._set_up(example, term, weight, n)

    def _set_up(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: np.ndarray) -> None:
        y, vocabulary = self.y, self.vocabulary
        often = np.flatnonzero(n >= max(DENSE_SHARE * len(y), 1))
        self.often = np.sort(often[np.argsort(-n[often], kind="stable")[:DENSE]])
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[self.often] = np.arange(len(self.often))
        self.dense = np.zeros((len(self.often), len(y)), np.float32)
        row = self.row[term]
        self.dense[row[row >= 0], example[row >= 0]] = weight[row >= 0]
        # the lists: by term, then by example; an entry for each block of a list
        self.example, term, self.weight = example[row < 0], term[row < 0], weight[row < 0]
        block = self.example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.at = block[first].astype(np.intp), np.append(first, len(term))
        self.example, self.weight = self.example.astype(np.intp), self.weight.astype(np.float64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.entries = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
        self.blocks = np.arange(0, len(y), BLOCK)

    def __reduce__(self):
        """A broadcast has the bare lists; every worker sets up its blocks and dense rows."""
        return _received, (self.vocabulary, self.idf.astype(np.float32), *self.sent, self.y, self.ids, self.knots)

    def broadcast(self, context: SparkContext) -> Broadcast:
        """Sent once, for training and for scores; knots that come later go with the task."""
        self.shared = self.shared or context.broadcast(self)
        return self.shared

    def weigh(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        q = (1 + np.log(times)) * self.idf[term]
        return q / np.sqrt(q @ q) if len(q) else q

    def base(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each query the part of the cosine with every example that dense rows give."""
        q = np.zeros((len(queries), len(self.often)), np.float32)
        for i, (term, weight) in enumerate(queries):
            row = self.row[term]
            q[i, row[row >= 0]] = weight[row >= 0]
        return q @ self.dense

    def nearest(self, term: np.ndarray, q: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of cosine over 0, nearest first, ties by place."""
        if not len(self.y):
            return np.zeros(0, np.int64), np.zeros(0)
        s = (self.base([(term, q)])[0] if base is None else base).astype(np.float64)
        n = self.entries[term + 1] - self.entries[term]
        entry, weight = tk.gather(self.entries[term], n), np.repeat(q, n)
        block = self.block[entry]
        bound = np.maximum.reduceat(s, self.blocks) + np.bincount(block, weight * self.most[entry], minlength=len(self.blocks))
        # the dense part of a cosine is a lower bound of it; of k and one that is skipped, k stay
        least = float(np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k else 0.0
        if 2 * (bound >= least - MARGIN).sum() > len(self.blocks):
            # most blocks have to be opened: the lists as they stand
            begin = self.at[self.entries[term]]
            m = self.at[self.entries[term + 1]] - begin
            p = tk.gather(begin, m)
            s += np.bincount(self.example[p], np.repeat(q, m) * self.weight[p], minlength=len(s))
            return self._first(s, np.arange(len(s)), k, skip)
        order = np.argsort(-bound, kind="stable")
        found = np.zeros(0, np.int64)
        for some in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            some = some[(bound[some] >= least - MARGIN) & (bound[some] > 0)]
            if not len(some):
                break
            own = _among(block, some, len(self.blocks))
            e, w = entry[own], weight[own]
            m = self.at[e + 1] - self.at[e]
            p = tk.gather(self.at[e], m)
            s += np.bincount(self.example[p], np.repeat(w, m) * self.weight[p], minlength=len(s))
            at = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = self._first(s, np.concatenate([found, at[at < len(s)]]), k, skip)[0]
            least = max(least, float(s[found[-1]])) if len(found) == k else least
        return found, s[found]

    @staticmethod
    def _first(s: np.ndarray, at: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places the k of the greatest s over 0, ties by place, and their s."""
        own = s[at]
        if len(at) > k + 1:  # one may be skipped
            at = at[own >= np.partition(own, len(at) - k - 1)[len(at) - k - 1]]
        at = at[(s[at] > 0) & (at != skip)]
        found = at[np.lexsort((at, -s[at]))][:k]
        return found, s[found]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """From -1 to 1: mean over the k places of the cosine, for or against."""
        return float((cosine * (2 * self.y[found] - 1)).sum() / NEAREST)


def _received(vocabulary, idf, example, n, weight, y, ids, knots) -> Index:
    index = Index(vocabulary, idf, (example, np.repeat(np.arange(len(n), dtype=np.int32), n), weight), y, ids)
    index.knots = knots
    return index


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y over x, with one case of each label added at either end's block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or len(blocks) > 1 and blocks[-2][3] == blocks[-1][2]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    prior = y.mean()
    at, value = [], []
    for s, n, low, high in blocks:
        p = (s + prior) / (n + 1)
        at += [low, high]
        value += [p, p]
    return np.array(at), np.maximum.accumulate(np.array(value))


def distinct(sets: list[np.ndarray]) -> np.ndarray:
    """Places of the sets that stay if in turn each with a Jaccard similarity of COPY per cent or more to one that stays goes; empty ones stay."""
    names, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_counts=True)
    rank = np.empty(len(names), np.int32)
    rank[np.argsort(times, kind="stable")] = np.arange(len(names))
    once = int((times == 1).sum())  # the lowest ranks: in one set alone, so no two sets meet there
    own: dict[int, np.ndarray] = {}
    heads: dict[int, list[int]] = {}
    stay = []
    for i, x in enumerate(sets):
        mine = np.sort(rank[np.searchsorted(names, x)])  # rarest first: copies share one of the first few
        head = mine[: len(mine) - (COPY * len(mine) + 99) // 100 + 1]
        head = head[head >= once].tolist()
        for j in sorted({j for h in head for j in heads.get(h, ())}):
            a, b = len(mine), len(own[j])
            if min(a, b) * 100 >= COPY * max(a, b):
                both = len(np.intersect1d(mine, own[j], assume_unique=True))
                if 100 * both >= COPY * (a + b - both):
                    break
        else:
            stay.append(i)
            own[i] = mine
            for h in head:
                heads.setdefault(h, []).append(i)
    return np.array(stay, np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Index:
    """The index over a bounded sample of labelled documents; of near copies among them (COPY per cent of their five-word shingles) the first stays."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches):
            doc, term, times = counts(part.column("text"))
            n = np.bincount(doc, minlength=part.num_rows)
            ends = np.concatenate([[0], np.cumsum(n)])
            codes, offsets, vocab = tk.words(part.column("text"), lower=True)
            five = (tk.rolling(tk.hashes(vocab)[codes], 5) >> np.uint64(32)).astype("<u4")
            own = [np.unique(five[a : b - 4]) if b - a > 4 else five[:0] for a, b in zip(offsets, offsets[1:])]
            shingles = tk.blobs(np.concatenate([five[:0], *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), shingles, tk.blobs(term, ends), tk.blobs(times.astype("<i4"), ends)], names=["doc_id", "y", "shingles", "terms", "times"])

    sample = examples(docs, labels, label, rows).mapInArrow(gather, "doc_id long, y int, shingles binary, terms binary, times binary")
    sample = written(sample.withColumn("row", F.monotonically_increasing_id()), "examples")
    # the driver's memory is short: shingles are let go before terms come, and arrays of all terms are few and small
    found = sample.select("doc_id", "y", "row", "shingles").toArrow()
    ids, first = np.unique(found.column("doc_id").to_numpy(), return_index=True)
    arrays = lambda table, name, kind, at: [np.frombuffer(table.column(name)[int(i)].as_buffer(), kind) for i in at]
    stay = distinct(arrays(found, "shingles", "<u4", first))
    ids, first = ids[stay], first[stay]
    y, row = found.column("y").to_numpy()[first].astype(np.int64), found.column("row").to_numpy()[first]
    del found
    pa.default_memory_pool().release_unused()
    found = sample.select("row", "terms", "times").toArrow()
    by = np.argsort(found.column("row").to_numpy())
    first = by[np.searchsorted(found.column("row").to_numpy()[by], row)]
    own = arrays(found, "terms", "<u8", first)
    size = np.array([len(t) for t in own], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    names = np.zeros(0, np.uint64)
    for i in range(0, len(own), BATCH):
        names = np.union1d(names, np.concatenate(own[i : i + BATCH]))
    which, weight, times = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32), arrays(found, "times", "<i4", first)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        which[a:b], weight[a:b] = np.searchsorted(names, own[i]), 1 + np.log(times[i])
    del found, own, times
    pa.default_memory_pool().release_unused()
    d = np.zeros((2, len(names)), np.int64)
    for k, a, b in zip(y, ends, ends[1:]):
        d[k, which[a:b]] += 1
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    share = n1 / (n1 + n0)
    more = (d[1] + PRIOR * share) / n1 / ((d[0] + PRIOR * (1 - share)) / n0)
    idf = np.log((len(y) + 1) / (d.sum(0) + 0.5)) * np.log2(2 + more)
    heaviest = np.zeros(len(y), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            w = weight[a:b] * idf[which[a:b]]
            weight[a:b] = w / max(np.sqrt(w @ w), 1e-300)
            heaviest[i] = which[a + w.argmax()]
    # like examples in a block: by label, then by heaviest term
    order = np.lexsort((heaviest, y))
    place = np.empty(len(y), np.int32)
    place[order] = np.arange(len(y))
    # examples in the order of their places fill the lists of their terms: no sort of all entries
    each = d.sum(0)
    begin = np.cumsum(each) - each
    example, listed = np.empty(len(which), np.int32), np.empty(len(which), np.float32)
    for p, i in enumerate(order):
        t = which[ends[i] : ends[i + 1]]
        example[begin[t]], listed[begin[t]] = p, weight[ends[i] : ends[i + 1]]
        begin[t] += 1
    del which, weight
    index = Index(names, idf, (example, np.repeat(np.arange(len(names), dtype=np.int32), each), listed), y[order], ids[order], search=False)
    if not len(y):
        return index
    by = np.argsort(row)
    row, place = row[by], place[by]
    sent = index.broadcast(docs.sparkSession.sparkContext)

    def against_others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The votes of all other examples on each one."""
        for batch in batches:
            own = sent.value
            at = np.minimum(np.searchsorted(row, batch.column("row").to_numpy()), len(row) - 1)
            stays = np.flatnonzero(row[at] == batch.column("row").to_numpy())
            at, votes = place[at[stays]], np.zeros(len(stays))
            for i in range(0, len(stays), BATCH):
                queries = []
                for j in stays[i : i + BATCH]:
                    term, times = (np.frombuffer(batch.column(name)[int(j)].as_buffer(), kind) for name, kind in (("terms", "<u8"), ("times", "<i4")))
                    term = np.searchsorted(own.vocabulary, term)
                    queries.append((term, own.weigh(term, times)))
                for j, ((term, q), base) in enumerate(zip(queries, own.base(queries)), i):
                    votes[j] = own.vote(*own.nearest(term, q, NEAREST, int(at[j]), base))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(votes)], names=["place", "vote"])

    got = sample.select("row", "terms", "times").mapInArrow(against_others, "place long, vote double").toArrow()
    votes = np.zeros(len(y))
    votes[got.column("place").to_numpy()] = got.column("vote").to_numpy()
    index.knots = _isotonic(votes, index.y.astype(float))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, evidence (up to three nearest examples: doc_id, y, cosine) of every whole text."""
    sent, knots = index.broadcast(docs.sparkSession.sparkContext), index.knots

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in tk.slices(batches):
            doc, term, times = counts(part.column("text"), own.vocabulary)
            votes, evidence = np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
            edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(edges[1:], len(doc))
            for i in range(0, len(edges), BATCH):
                at = list(zip(edges[i : i + BATCH], ends[i : i + BATCH]))
                queries = [(t := term[a:b].astype(np.int64), own.weigh(t, times[a:b])) for a, b in at]
                for (a, _), (t, q), base in zip(at, queries, own.base(queries)):
                    found, cosine = own.nearest(t, q, NEAREST, base=base)
                    votes[doc[a]] = own.vote(found, cosine)
                    evidence[doc[a]] = [{"doc_id": int(own.ids[j]), "y": int(own.y[j]), "cosine": float(c)} for j, c in zip(found[:3], cosine)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(np.interp(votes, *knots)), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("y", pa.int32()), ("cosine", pa.float64())])))],
                names=["doc_id", "held_out", "score", "evidence"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,y:int,cosine:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.7), evidence.

    Learns from ``rows`` labelled documents at most, held-out ones never.  A
    text without a term of the index, null and empty ones too, scores as the
    examples without neighbours do; repeated rows and null doc_ids are kept,
    other columns left out; no labels give 0.
    """
    found = score(docs, train(docs, labels, "toxic", rows))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "evidence")
