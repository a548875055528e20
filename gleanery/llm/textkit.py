"""Whole-text kernels shared by the corpus operators.

Spark deals documents to tasks; inside a task these helpers work on one Arrow
batch at a time with numpy.  Every word of every text is seen once, per-word
work (hashing, tokenizing, scoring) is done once per distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = np.uint64(29)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def merged(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes, small neighbours put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, text, limit):
        more = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none).

    Returns the code of each word, the offsets of the documents in the codes
    and the distinct words by code.  ``lower`` folds A-Z only.
    """
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    codes, vocab = coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(vocab, "").as_py() if len(vocab) else -1
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, vocab


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> np.uint64(32))


def hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _M1 + b * _M3 + _M2)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position, by doubling; short tails go."""
    if len(h) < k:
        return h[:0]
    out, have, power, at = None, 0, h, 1
    while True:
        if k & at:
            out = power if out is None else pair(out[: len(power) - have], power[have:][: len(out)]) if len(power) > have else out[:0]
            have += at
        if have == k:
            return out[: len(h) - k + 1]
        power = pair(power[:-at], power[at:])
        at *= 2


def window_docs(offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For window starts 0..n-k of the flat words: a mask of those inside one document, and the document of each word."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    return inside, doc


def crc32s(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian 32-bit integers."""
    import zlib

    raw = memoryview(np.ascontiguousarray(flat, "<u4").tobytes())
    at = (offsets * 4).tolist()
    return np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])), np.int64, len(at) - 1)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the runs [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total)
    return out


def int_lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def blobs(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that hold the runs of ``flat``."""
    flat = np.ascontiguousarray(flat)
    at = np.asarray(offsets, np.int64) * flat.itemsize
    if len(at) and at[-1] > 2**31 - 1:
        raise ValueError("a batch of blobs is over 2 GB; use smaller slices")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
