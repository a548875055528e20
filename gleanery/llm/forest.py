"""Approximate nearest neighbours: a hash-prefix forest over every slice of the vectors.

A vector's hash string in a tree is a row of digits; a digit is the axis of a
random frame of 16 directions that the vector points along most, with its
sign.  A tree is the sorted array of its slice's strings.  A query descends in
every tree to the strings that share its longest prefixes, then ascends in all
trees at once, a digit at a time, until it has met enough distinct vectors;
these are compared by their exact cosine.  Slices answer alone, so that no
vector is shuffled; only each slice's best leave its task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, storage
from . import textkit as tk

#: Trees; digits of a string; directions of a digit's frame (a digit has 5 bits).
TREES, DIGITS, FRAME, BITS = 192, 6, 16, 5
#: Vectors and bytes of a slice.
SLICE, SLICE_BYTES = 1 << 14, 16 << 20
#: A query ascends until it has met this many vectors of a slice, or this part of it if that is more.
LEAST, PART = 512, 8
#: Queries sent to all slices at once.
BLOCK = 1 << 14
INDEX = "dim int, counts binary, ids binary, vectors binary, keys binary, places binary"
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, so that no square over- or underflows, and their unit vectors; all-zero rows are none."""
    top = np.abs(x).max(1)
    x = np.ldexp(x, -np.frexp(top)[1][:, None])
    return x, (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def strings(unit: np.ndarray, tree: int) -> np.ndarray:
    """The hash string of each unit vector in a tree, first digit in the highest bits."""
    dim = unit.shape[1]
    frames = np.random.default_rng([11, dim, tree]).standard_normal((dim, DIGITS * FRAME), np.float32)
    along = (unit @ frames).reshape(len(unit), DIGITS, FRAME)
    axis = np.abs(along).argmax(2)
    digit = 2 * axis + (np.take_along_axis(along, axis[:, :, None], 2)[:, :, 0] > 0)
    return (digit.astype(np.uint32) << (BITS * np.arange(DIGITS - 1, -1, -1)).astype(np.uint32)).sum(1, dtype=np.uint32)


def _grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of slices: distinct vectors with the ids of each, and all trees over them."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for rows, x in blocks.matrices(batch.column("embedding")):
            some = x.any(1)
            rows, x = rows[some], x[some]
            step = max(1, min(SLICE, SLICE_BYTES // (8 * x.shape[1])))
            for at in range(0, len(x), step):
                part = np.ascontiguousarray(x[at : at + step]) + 0.0  # one zero only
                own = ids[rows[at : at + step]].astype(np.int64)
                raw = part.view(np.dtype((np.void, part.shape[1] * 8))).ravel()
                _, first, code = np.unique(raw, return_index=True, return_inverse=True)
                order = np.lexsort((own, code))
                unit = directions(part[first])[1]
                keys = [strings(unit, t) for t in range(TREES)]
                sorts = [np.argsort(k, kind="stable") for k in keys]
                row = {
                    "dim": x.shape[1],
                    "counts": np.bincount(code).astype("<i4").tobytes(),
                    "ids": own[order].astype("<i8").tobytes(),
                    "vectors": part[first].astype("<f8").tobytes(),
                    "keys": np.concatenate([k[s] for k, s in zip(keys, sorts)]).astype("<u4").tobytes(),
                    "places": np.concatenate(sorts).astype("<u2").tobytes(),
                }
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == "dim" else pa.binary()) for k, v in row.items()], list(row))


class Slice:
    """One row of the index."""

    def __init__(self, row: dict):
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.counts)
        self.vectors, self.unit = directions(np.frombuffer(row["vectors"], "<f8").reshape(n, -1))
        self.keys = np.frombuffer(row["keys"], "<u4").reshape(TREES, n)
        self.places = np.frombuffer(row["places"], "<u2")

    def ranges(self, query_keys: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and tree, where in the flat places the strings with its first digits lie: starts and lengths. query_keys by tree."""
        low = np.uint32(BITS * (DIGITS - digits))
        lo, n = (query_keys >> low) << low, len(self.counts)
        hi = lo | np.uint32((1 << int(low)) - 1)
        a = np.stack([np.searchsorted(k, x, "left") for k, x in zip(self.keys, lo)], 1)
        b = np.stack([np.searchsorted(k, x, "right") for k, x in zip(self.keys, hi)], 1)
        return a + np.arange(TREES) * n, b - a

    def met(self, query_keys: np.ndarray) -> Iterator[np.ndarray]:
        """Of each query, the vectors that it meets."""
        n = len(self.counts)
        least = min(n, max(LEAST, n // PART))
        if least == n:
            yield from (np.arange(n) for _ in range(query_keys.shape[1]))
            return
        levels = {d: self.ranges(query_keys, d) for d in range(DIGITS, 0, -1)}
        for q in range(query_keys.shape[1]):
            for starts, lengths in levels.values():
                if lengths[q].sum() >= least:  # fewer strings can't be enough vectors
                    seen = np.zeros(n, bool)
                    seen[self.places[tk.gather(starts[q], lengths[q])]] = True
                    if np.count_nonzero(seen) >= least:
                        yield np.flatnonzero(seen)
                        break
            else:
                yield np.arange(n)

    def best(self, query: np.ndarray, own: int, found: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest of the found vectors (score, id), rows of the query's own id left out."""
        at, times = np.unique(np.searchsorted(self.ends, np.flatnonzero(self.ids == own), "right"), return_counts=True)
        found = np.setdiff1d(found, at[times == self.counts[at]], assume_unique=True)
        near = self.unit[found] @ (query / np.sqrt((query * query).sum())).astype(np.float32)
        if len(near) > k:  # rough scores are this near to exact ones
            found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - len(query) * 2.0**-22]
        out = []
        for at in found.tolist():
            score = cosine(query, self.vectors[at])
            ids = self.ids[self.ends[at] - self.counts[at] : self.ends[at]]
            out += [(score, i) for i in ids[ids != own][:k].tolist()]
        return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in doubles; each sum is rounded once, so that equal vectors have equal scores wherever they are."""
    return fsum((a * b).tolist()) / (sqrt(fsum((a * a).tolist())) * sqrt(fsum((b * b).tolist())))


def index(vectors: DataFrame) -> DataFrame:
    """The forest of every slice of vec_id, embedding, as a written table; a row is a slice.

    Vectors of different lengths are in slices apart.  Vectors that are null,
    empty, all zero or hold null or non-finite components, and rows without a
    vec_id, take no part.  Equal vectors of a slice are one with several ids.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return storage.written(rows.mapInArrow(_grown, INDEX), "forest")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query by cosine, ties to the smaller vec_id.

    queries has rows of vectors' form, which needn't be among them.  Rows of a
    query's own vec_id are no candidates.  Which vectors take part: see index.
    Rows that share a vec_id are vectors of their own, and queries of their
    own; a query's rank then goes on over what they find.  An empty table of
    either gives no rows.
    """
    spark = vectors.sparkSession
    forest = index(vectors)
    asked = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for block in blocks.dealt(asked, BLOCK):
        ids = block["vec_id"].combine_chunks().to_numpy(zero_copy_only=False)
        lists = block["embedding"].combine_chunks()
        sent = spark.sparkContext.broadcast({x.shape[1]: (ids[rows[some]], directions(x[some])) for rows, x in blocks.matrices(lists) if (some := x.any(1)).any()})

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if row["dim"] not in sent.value:
                        continue
                    own, (x, unit) = sent.value[row["dim"]]
                    if row["dim"] not in keys:
                        keys[row["dim"]] = np.stack([strings(unit, t) for t in range(TREES)])
                    part = Slice(row)
                    best = [(q, i, s) for q, v, met in zip(own.tolist(), x, part.met(keys[row["dim"]])) for s, i in part.best(v, q, met, k)]
                    yield pa.RecordBatch.from_pylist([dict(zip(_BEST.names, b)) for b in best], schema=_BEST)

        more = forest.mapInArrow(search, "query_id long, vec_id long, score double")
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
