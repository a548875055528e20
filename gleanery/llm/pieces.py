"""Counting greedy word pieces with a linear longest-match automaton.

The vocabulary is a trie.  A node where no edge fits the next byte has a
failure link, to the node that greedy longest match is in after it gave up its
pieces, and the number of the pieces it gave up.  A word is then counted in one
walk over its bytes, without back-tracking and without building a piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

_READY: dict[tuple, "Automaton"] = {}


class Automaton:
    """``initial``: pieces at a word's start; ``rest``: pieces after it, the same where not given."""

    def __init__(self, initial: Iterable[bytes], rest: Iterable[bytes] | None = None):
        sets = [set(initial)]
        if rest is not None:
            sets.append(set(rest))
        edges: list[dict[int, int]] = []
        ends: list[bool] = []

        def node() -> int:
            edges.append({})
            ends.append(False)
            return len(edges) - 1

        roots = [node() for _ in sets]
        for root, pieces in zip(roots, sets):
            for piece in pieces:
                at = root
                for c in piece:
                    at = edges[at].get(c) or edges[at].setdefault(c, node())
                ends[at] = at != root
        after = roots[-1]  # a piece that is given up leaves the walk here
        fail, popped = [-1] * len(edges), [0] * len(edges)
        queue = list(roots)
        for u in queue:
            for c, v in edges[u].items():
                queue.append(v)
                if ends[v]:
                    fail[v], popped[v] = after, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and c not in edges[z]:
                    n, z = n + popped[z], fail[z]
                if z >= 0:
                    fail[v], popped[v] = edges[z][c], n
        # pieces of a word that ends in a node; -1 where the vocabulary can't spell it
        self.left = np.full(len(edges), -1, np.int64)
        self.left[roots] = 0
        for v in queue:
            chain, at = [], v
            while self.left[at] < 0 and fail[at] >= 0:
                chain.append(at)
                at = fail[at]
            for x in reversed(chain):
                if self.left[fail[x]] >= 0:
                    self.left[x] = popped[x] + self.left[fail[x]]
        self.fail, self.popped, self.root = np.array(fail), np.array(popped), roots[0]
        key = np.array([u * 256 + c for u, own in enumerate(edges) for c in own], np.int64)
        to = np.array([v for own in edges for v in own.values()], np.int64)
        order = np.argsort(key)
        self.key, self.to = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0)

    def count(self, words: pa.Array, unknown: int = 1) -> np.ndarray:
        """Pieces of each word, all words in step; ``unknown`` for a word that can't be spelled."""
        words = words.cast(pa.binary())
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        start, size = offsets[:-1][order], size[order]
        at, n = np.full(len(order), self.root), np.zeros(len(order), np.int64)
        live = np.ones(len(order), bool)
        for step in range(int(size[0]) if len(size) else 0):
            active = np.flatnonzero(live[: int(np.searchsorted(-size, -step, "left"))])
            byte = data[start[active] + step].astype(np.int64)
            while len(active):
                want = at[active] * 256 + byte
                i = np.searchsorted(self.key, want)
                found = self.key[i] == want
                at[active[found]] = self.to[i[found]]
                active, byte = active[~found], byte[~found]
                n[active] += self.popped[at[active]]
                at[active] = self.fail[at[active]]
                dead = at[active] < 0
                live[active[dead]] = False
                active, byte = active[~dead], byte[~dead]
        more = np.where(live, self.left[np.maximum(at, 0)], -1)
        out = np.empty(len(order), np.int64)
        out[order] = np.where(more < 0, unknown, n + more)
        return out


def byte_level(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes."""
    # fixed values: bytes that stand for themselves in such files; the others follow from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [bytes(chars[c] for c in piece) for piece in vocab if all(c in chars for c in piece)]


def automaton(path: str) -> Automaton:
    """The worker's automaton of a byte-level vocabulary file, kept between tasks."""
    if path not in _READY:
        _READY[path] = Automaton(byte_level(path))
    return _READY[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens (greedy longest-match pieces of all its words).

    A word ``[^\\x20\\x09-\\x0D]+`` is matched behind one space, as such
    vocabularies mark a word's start; whole texts, a null or empty text has 0 of
    both.  Null and repeated doc_ids are kept as they are, other columns left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = automaton(vocabulary)
        for part in tk.slices(batches):
            codes, offsets, vocab = tk.words(part.column("text"))
            each = walk.count(pa.compute.binary_join_element_wise(pa.scalar(b"", pa.binary()), vocab.cast(pa.binary()), pa.scalar(b" ", pa.binary())))
            total = np.concatenate([[0], np.cumsum(each[codes])])[offsets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
