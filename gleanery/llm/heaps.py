"""Centroid clustering with heap-ordered bounds, in whole numbers.

A vector that has been compared with all centroids knows how much nearer its
own is than the second: its gap.  A round takes from a gap no more than its
cluster's drift, that is how far the own centroid and the one that moved most
of the others have gone.  Every cluster of a block keeps a heap of gaps, each
offset by the cluster's drift so far when it came in; a round pops those that
the drift has used up, compares these vectors exactly with all centroids and
pushes them again.  All others keep their centroid, which is provably the
nearest.

Blocks of vectors with their heaps are the rows of a frame; a round is one
narrow pass over it and one small sum of what the moved vectors add to and
take from the centroids.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, storage

#: Vectors of a block.
BLOCK = 4096
#: Components of 2**26 or more (of vectors times SCALE) would give distances that aren't longs.
SCALE, LARGEST = 1024, 1 << 26
#: What rounding could make a gap or a drift wrong by, relative to the distances in it.
SLACK = 1e-9
ROWS = "ids array<long>, vectors binary, nearest binary, heap binary, members binary, moved array<long>, compared long"
_KINDS = {"ids": pa.list_(pa.int64()), "moved": pa.list_(pa.int64()), "compared": pa.int64()}


def _blocks(dims: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in blocks.matrices(batch.column("embedding")):
            if x.shape[1] != dims:
                continue
            x = np.floor(SCALE * x)
            fine = (np.abs(x) < LARGEST).all(1)
            ids, x = batch.column("vec_id").take(pa.array(rows[fine])), x[fine].astype("<i4")
            for at in range(0, len(x), BLOCK):
                yield _row(ids[at : at + BLOCK].to_pylist(), x[at : at + BLOCK], np.full(len(x[at : at + BLOCK]), -1), [], np.zeros(0, np.int64), 0)


def _row(ids, x, nearest, heaps, moved, compared) -> pa.RecordBatch:
    row = {
        "ids": ids,
        "vectors": x.tobytes(),
        "nearest": nearest.astype("<i4").tobytes(),
        "heap": np.array([e[0] for h in heaps for e in h], "<f8").tobytes(),
        "members": np.array([*(len(h) for h in heaps), *(e[1] for h in heaps for e in h)], "<i4").tobytes(),
        "moved": moved.tolist(),
        "compared": compared,
    }
    return pa.RecordBatch.from_arrays([pa.array([v], _KINDS.get(k, pa.binary())) for k, v in row.items()], list(row))


class Block:
    """A block's vectors, their clusters and the clusters' heaps of (gap + drift when pushed, place)."""

    def __init__(self, row: dict, k: int, dims: int):
        self.ids = row["ids"]
        self.x = np.frombuffer(row["vectors"], "<i4").reshape(-1, dims)
        self.nearest = np.frombuffer(row["nearest"], "<i4").astype(np.int64)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        if row["members"]:
            members, gaps, at = np.frombuffer(row["members"], "<i4").tolist(), np.frombuffer(row["heap"], "<f8").tolist(), 0
            for c, n in enumerate(members[:k]):
                self.heaps[c] = list(zip(gaps[at : at + n], members[k + at : k + at + n]))
                at += n

    def expired(self, drift: list[float]) -> np.ndarray:
        """Pops who may have another nearest centroid: gaps that the drift has used up, and who was never compared."""
        out = np.flatnonzero(self.nearest < 0).tolist()
        for heap, gone in zip(self.heaps, drift):
            while heap and heap[0][0] <= gone:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def assign(self, centroids: np.ndarray, drift: list[float]) -> tuple[np.ndarray, int]:
        """One round: what moves between clusters (counts and components by cluster), and how many were compared."""
        popped, k = self.expired(drift), len(centroids)
        moved = np.zeros((k, 1 + self.x.shape[1]), np.int64)
        if len(popped):
            x = self.x[popped].astype(np.int64)
            far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
            now, was = far.argmin(1), self.nearest[popped]
            own = np.sqrt(far[np.arange(len(popped)), now])
            far[np.arange(len(popped)), now] = np.iinfo(np.int64).max
            second = np.sqrt(far.min(1)) if k > 1 else np.full(len(popped), np.inf)
            gaps = (second - own) - SLACK * (second + own + 1) if k > 1 else second
            for place, c, gap in zip(popped.tolist(), now.tolist(), gaps.tolist()):
                heapq.heappush(self.heaps[c], (gap + drift[c], place))
            self.nearest[popped] = now
            for sign, where in ((1, now), (-1, was)):
                for c in range(k):
                    rows = x[(where == c) & (now != was)]
                    moved[c, 0] += sign * len(rows)
                    moved[c, 1:] += sign * rows.sum(0)
        return moved, len(popped)


def _passes(batches: Iterable[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield step(batch.slice(i, 1).to_pylist()[0])


def moves(centroids: list[list[int]], new: list[list[int]]) -> list[float]:
    """The drift of each cluster between two sets of centroids, rounded up: its own centroid's way and the longest of the others'."""
    ways = [float(sum((a - b) ** 2 for a, b in zip(old, now))) ** 0.5 for old, now in zip(centroids, new)]
    return [0.0 if not any(ways) else (way + max([0.0, *ways[:c], *ways[c + 1 :]])) * (1 + SLACK) + SLACK for c, way in enumerate(ways)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of ``dims`` finite components.

    A component x counts as floor(1024 x).  Centroids start as the k vectors
    of smallest sha256 of salt and vec_id (equal ones by components; a null
    vec_id comes last); each round assigns every vector to the nearest, ties
    to the smaller number, and sets every centroid that has vectors to their
    exact floored mean; at last vectors are assigned once more.  Vectors that
    are null, of another length or hold null or non-finite components are left
    out, and so are those with a component of 65,536 or more in size, whose
    distances are no longs.  Rows that share a vec_id are vectors of their
    own.  Fewer vectors than k give as many clusters; none give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = storage.written(rows.mapInArrow(lambda batches: _blocks(dims, batches), ROWS), "vectors")
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST // SCALE) & (x < LARGEST // SCALE) & (x > -(LARGEST - 1) / SCALE))
    scaled = rows.where((F.size("embedding") == dims) & fine)
    scaled = scaled.select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("x"))
    starts = scaled.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)), "x").limit(k).collect()
    centroids, k = [list(r["x"]) for r in starts], len(starts)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    counts, sums, drift = [0] * k, [[0] * dims for _ in range(k)], [0.0] * k
    state, settled = whole, False
    for turn in range(rounds + 1):

        def step(row: dict, centroids=centroids, drift=drift) -> pa.RecordBatch:
            block = Block(row, len(centroids), dims)
            moved, compared = block.assign(np.array(centroids, np.int64), drift)
            return _row(block.ids, block.x, block.nearest, block.heaps, moved.ravel(), compared)

        after = state.mapInArrow(lambda batches, step=step: _passes(batches, step), ROWS).persist(StorageLevel.MEMORY_AND_DISK)
        # k (dims + 1) sums, whatever the vectors are
        slots = after.select(F.posexplode("moved").alias("slot", "value")).groupBy("slot").agg(F.sum("value").alias("value")).collect()
        if state is not whole:
            state.unpersist()
        state = after
        if turn == rounds or settled:
            break
        for slot, value in slots:
            c, at = divmod(slot, dims + 1)
            if at:
                sums[c][at - 1] += value
            else:
                counts[c] += value
        new = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids)]
        way = moves(centroids, new)
        settled = new == centroids  # later rounds change nothing
        drift, centroids = [a + b for a, b in zip(drift, way)], new

    def found(batches: Iterable[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], len(centroids), dims)
                far = ((block.x.astype(np.int64) - np.array(centroids, np.int64)[block.nearest]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.nearest, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = storage.written(state.mapInArrow(found, "vec_id long, cluster int, distance long"), "clusters")
    state.unpersist()
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        pick([inertia.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        pick(digests).alias("centroid_sha256"),
    )
