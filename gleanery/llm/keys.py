"""Which keys of a corpus occur again, and where: the shuffle that several operators share.

A task hashes a slice of documents to (key, document, mark) entries, settles
what it can among its own, and sends one entry a key to the key's bucket, many
in one binary row.  A bucket compares what all slices sent and answers with
marks per document.  However often a key occurs, a bucket gets one entry of it
from each slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Bytes of text of which a task compares the keys before it sends them.
SLICE = 8 << 20
_SENT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("marks", pa.binary())])
_ANSWER = pa.schema([("owner", pa.int32()), ("docs", pa.binary()), ("marks", pa.binary())])
_MARKS = pa.schema([("doc", pa.int64()), ("marks", pa.binary())])
#: Bytes of text of which a bucket gets the keys, about.
BUCKET = 64 << 20
#: keys, further key bits, document, mark of each entry
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _verdict(keys, more, docs, marks, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, hit): entries sorted by key, document and mark; hit: the key occurs again, or with ``later`` occurs before."""
    order = np.lexsort((marks, docs, more, keys))
    k, m, d, p = keys[order], more[order], docs[order], marks[order]
    same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    if not later:
        hit = np.zeros(len(order), bool)
        hit[1:] |= same
        hit[:-1] |= same
        return order, hit
    first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order, (d != d[lead]) | (p != p[lead])


def _read(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])


def _by_doc(table: pa.Table) -> pa.Table:
    """All marks of each document of a bucket."""
    docs, marks = _read(table, "docs", "<i8"), _read(table, "marks", "<i4")
    order = np.lexsort((marks, docs))
    docs, marks = docs[order], marks[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return pa.table([pa.array(docs[at]), tk.blobs(marks.astype("<i4"), np.append(at, len(docs)))], schema=_MARKS)


def buckets(docs: DataFrame) -> int:
    """How many buckets the keys of all texts want: a bucket is as large at every size of the table."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def marked(docs: DataFrame, entries: Callable[[pa.RecordBatch], Entries], n: int, later: bool = False) -> DataFrame:
    """doc, marks (binary, little-endian 32-bit): the marks of each document whose keys other entries share.

    docs: the columns that ``entries`` wants, ``text`` among them.  ``later``
    marks an entry only if the same key occurs at a smaller (document, mark).
    n: buckets that the keys are dealt to.  A document without marks has no row.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.merged(batches, limit=SLICE):
            keys, more, ids, marks = entries(part)
            if not len(keys):
                continue
            order, hit = _verdict(keys, more, ids, marks, later)
            k, m = keys[order], more[order]
            first = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
            settled = order[hit]
            rows = []
            if len(settled):
                rows.append((int(keys[settled[0]] % np.uint64(n)), True, b"", b"", ids[settled].astype("<i8").tobytes(), marks[settled].astype("<i4").tobytes()))
            out = order[first]
            out.sort()  # documents in order compress better
            bucket = (keys[out] % np.uint64(n)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            out, bucket = out[by], bucket[by]
            # only buckets that the slice has keys for, however many there are
            at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(out))
            for a, z in zip(at, at[1:]):
                i = out[a:z]
                rows.append((int(bucket[a]), False, keys[i].astype("<u8").tobytes(), more[i].astype("<u4").tobytes() if more[i].any() else b"", ids[i].astype("<i8").tobytes(), marks[i].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT.types)], schema=_SENT)

    def meet(table: pa.Table) -> pa.Table:
        done = table.filter(table.column("settled"))
        rest = table.filter(pa.compute.invert(table.column("settled")))
        keys, ids, marks = _read(rest, "keys", "<u8"), _read(rest, "docs", "<i8"), _read(rest, "marks", "<i4")
        more = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") if x else np.zeros(len(k) // 8, "<u4") for x, k in zip(rest.column("more").to_pylist(), rest.column("keys").to_pylist()))])
        order, hit = _verdict(keys, more, ids, marks, later)
        found = order[hit]
        ids, marks = np.concatenate([ids[found], _read(done, "docs", "<i8")]), np.concatenate([marks[found], _read(done, "marks", "<i4")])
        owner = ids % n
        order = np.lexsort((ids, owner))
        ids, marks, owner = ids[order], marks[order], owner[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(ids)) if len(ids) else np.zeros(1, np.int64)
        return pa.table([pa.array(owner[at[:-1]].astype(np.int32)), tk.blobs(ids.astype("<i8"), at), tk.blobs(marks.astype("<i4"), at)], schema=_ANSWER)

    sent = docs.mapInArrow(send, "bucket int, settled boolean, keys binary, more binary, docs binary, marks binary")
    answers = sent.groupBy("bucket").applyInArrow(meet, "owner int, docs binary, marks binary")
    return answers.groupBy("owner").applyInArrow(_by_doc, "doc long, marks binary")


def joined(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """docs (with a ``doc`` column) and the marks of each."""
    return docs.join(marks.hint("shuffle_hash"), "doc", how)


def positions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Marks of a column: the row of each and the mark."""
    parts = [np.frombuffer(x or b"", "<i4") for x in column.to_pylist()]
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate([np.zeros(0, "<i4"), *parts]).astype(np.int64)
