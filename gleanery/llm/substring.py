"""Removing repeated passages, found by difference-cover anchors.

A set of residues D modulo v is a difference cover if every difference modulo
v occurs between two of its members.  Two equal windows, at any two starts,
then have an offset below v at which both positions fall on D; so it is enough
to hash short anchors at the positions whose residue is in D.  Windows around
an anchor that occurs again are candidates; their exact word sequences, by
96-bit hashes, decide which start is the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keys
from . import textkit as tk

#: Words of a window.
WINDOW = 20
#: Perfect difference sets by modulus.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Stands for a null doc_id, which counts as the least.
NO_ID = -(1 << 63)


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves an anchor two fifths of the window; 1 for short windows."""
    fit = [v for v in COVERS if v - 1 <= 0.6 * window]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def repeats(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """doc, text, carried columns, marks: each document (doc: doc_id, null as NO_ID) with the starts of its windows that occur before."""
    period, residues = cover(window)
    size = window - period + 1
    on = np.isin(np.arange(period), residues)

    def anchors(part: pa.RecordBatch) -> keys.Entries:
        codes, offsets, vocab = tk.words(part.column("text"))
        h = tk.rolling(tk.hashes(vocab)[codes], size)
        inside, doc = tk.window_docs(offsets, size, len(codes))
        doc = doc[: len(h)]
        pos = np.arange(len(h)) - offsets[doc]
        at = np.flatnonzero(inside & on[pos % period])
        ids = part.column("doc").to_numpy()
        return h[at], np.zeros(len(at), np.uint32), ids[doc[at]], pos[at].astype(np.int32)

    def windows(part: pa.RecordBatch) -> keys.Entries:
        codes, offsets, vocab = tk.words(part.column("text"))
        n = len(codes)
        inside, doc = tk.window_docs(offsets, window, n)
        rows, marks = keys.positions(part.column("marks"))
        ok = marks + size <= np.diff(offsets)[rows]
        flat, floor = (offsets[rows] + marks)[ok], offsets[rows][ok]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(flat - (period - 1), floor), 1)
        np.add.at(edge, flat + 1, -1)
        at = np.flatnonzero(inside & (np.cumsum(edge)[: len(inside)] > 0))
        one, two = (tk.rolling(tk.hashes(vocab, seed)[codes], window)[at] for seed in (1, 2))
        ids = part.column("doc").to_numpy()
        return one, (two >> np.uint64(32)).astype(np.uint32), ids[doc[at]], (at - offsets[doc[at]]).astype(np.int32)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text", *(F.col(c).alias(f"with_{c}") for c in carry or []))
    n = keys.buckets(rows)
    candidates = keys.joined(rows, keys.marked(rows, anchors, n), "inner")
    return keys.joined(rows, keys.marked(candidates, windows, n, later=True), "left")


def substring_dedup(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, text (kept words joined by one space), n_words, n_removed, spans; and, with ``carry``, those columns, the text as it was where nothing went.

    A window is ``window`` consecutive words of one document.  Each word of a
    window whose word sequence also starts earlier (smaller doc_id, or the same
    document before) goes; windows are those of the input.  ``spans`` are the
    removed [start, end) word ranges.

    A null text has no words, a null doc_id comes before all others, texts of
    fewer words stay whole, other columns are left out.  Rows that repeat a
    doc_id are one document: with its text they get the same verdict, with
    other texts a window goes from each at the starts that go in one of them,
    so a table should give each text an id of its own.  No rows give none.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, limit=16 << 20):
            rows, marks = keys.positions(part.column("marks"))
            edges = np.flatnonzero(np.diff(rows)) + 1 if len(rows) else []
            own = dict(zip(rows[np.concatenate([[0], edges]).astype(int)].tolist(), np.split(marks, edges))) if len(rows) else {}
            texts, n_words, n_removed, spans = [], [], [], []
            for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                n_words.append(len(words))
                cut: list[dict] = []
                if i in own:
                    starts = np.unique(own[i])
                    starts = starts[starts + window <= len(words)]
                    if len(starts):
                        gap = np.flatnonzero(np.diff(starts) > window)
                        firsts, lasts = starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + window
                        cut = [{"start": int(a), "end": int(b)} for a, b in zip(firsts, lasts)]
                kept, at = [], 0
                for s in cut:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                texts.append(text if carry is not None and not cut else b" ".join(kept))
                n_removed.append(len(words) - len(kept))
                spans.append(cut)
            doc = part.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, mask=doc == NO_ID), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *(part.column(f"with_{c}") for c in carry or [])],
                names=["doc_id", "text", "n_words", "n_removed", "spans", *(carry or [])],
            )

    found = repeats(docs, window, carry)
    more = [T.StructField(c, docs.schema[c].dataType) for c in carry or []]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    own = [("doc_id", T.LongType()), ("text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", span)]
    return found.mapInArrow(keep, T.StructType([*(T.StructField(k, t) for k, t in own), *more]))
