"""Packing documents into sequences by the sum-of-squares rule.

A document goes where the sum, over residual gaps, of the squared number of
open sequences with that gap becomes smallest; a new sequence is one of the
choices.  The rule needs the counts per gap alone, so each task packs its own
documents without a shuffle.  What lies in sequences that a task leaves open is
taken out again and packed once more, that of many tasks together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import storage
from . import textkit as tk
from . import tokens

#: Tokens of a sequence.
SEQUENCE = 2048
#: Pieces of open sequences that one task packs again, about.
AGAIN = 200_000
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, full boolean"


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents: (document, start, length). Only longer ones are cut; the first piece is the shorter."""
    n = -(-lengths // most)
    doc = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = lengths - (n - 1) * most
    start = np.where(number == 0, 0, first[doc] + (number - 1) * most)
    return doc, start, np.where(number == 0, first[doc], most)


def place(lengths: np.ndarray, most: int, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (1..most), longest first, ties in the given order; and the fill of each bin.

    With N(g) open bins of gap g, an item of size s changes the sum of squares
    by 2 (N(g-s) - N(g)) + 2 in a bin of gap g, by 1 - 2 N(s) where it fills
    the bin, and by 2 N(most-s) + 1 in a new one.  The smallest change wins; of
    equal ones an open bin before a new one, then the smallest gap.  With
    ``last`` a new bin is a choice only where no open one has room.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(most + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(most + 1)]
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap, b = most, len(fill)
        if s < most:
            now = count[s:most]
            change = 2 * (count[: most - s] - now) + 2
            change[0] = 1 - 2 * now[0]  # fills the bin
            change = np.where(now > 0, change, np.iinfo(np.int64).max)
            g = int(np.argmin(change))
            if now[g] and (last or change[g] <= 2 * count[most - s] + 1):
                gap = s + g
                b = open_[gap].pop()
                count[gap] -= 1
        if b == len(fill):
            fill.append(0)
        bins[i], offsets[i] = b, most - gap
        fill[b] += s
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, np.array(fill, np.int64)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, most: int = SEQUENCE, cut_at: str = "spaces") -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    docs: doc_id and text; other columns are left out, a null text is an empty
    one (its end id alone), repeated rows are packed each, no rows give none.
    Only documents over ``most`` ids are cut.  A null doc_id is kept as it is.
    A task holds lengths and checksums of its documents, never their ids.
    """

    def placed(doc_id: pa.Array, number, start, length, crc, base: int) -> pa.RecordBatch:
        bins, offset, fill = place(length, most, base > 0)
        bins_full = fill[bins] == most
        bins += (base + TaskContext.get().partitionId()) << 40
        return pa.RecordBatch.from_arrays([doc_id, pa.array(number, pa.int32()), *map(pa.array, (start, length, crc, bins, offset, bins_full))], names=[*COLUMNS, "full"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer, cut_at)
        held: list[tuple] = []
        for part in tk.slices(batches, limit=tokens.SLICE):
            ids, at = coder.encode(part.column("text"), end)
            doc, start, length = cut(np.diff(at), most)
            edges = at[doc] + start
            crc = tk.crc32s(ids, np.append(edges, at[-1]))
            first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            number = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
            held.append((part.column("doc_id").take(pa.array(doc)), number, start, length, crc))
        if not held:
            return
        yield placed(pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in range(1, 5)), 0)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield placed(t.column("doc_id").chunk(0), *(t.column(c).to_numpy() for c in COLUMNS[1:5]), 1 << 22)

    first = storage.written(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA), "pieces")
    rest = first.where("not full")
    tasks = -(-rest.count() // AGAIN)
    if tasks:
        by = ["doc_id", "piece", "ids_crc32"]
        first = first.where("full").unionAll(rest.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(again, SCHEMA))
    return first.select(COLUMNS)
