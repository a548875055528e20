"""Stated query sets in blocks of bounded size, and vectors as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textkit as tk


def dealt(frame: DataFrame, limit: int, weight: str | None = None) -> Iterator[pa.Table]:
    """The rows of frame in blocks that weigh about ``limit`` each (rows, or the sum of ``weight``), one block at a time in the driver.

    A row's block is drawn once, in a written table, so that it is the same in
    every attempt; a row that weighs more than the limit fills a block alone
    or with what is dealt to it.
    """
    whole = F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0)) if weight else F.count("*").cast("double")
    kept = storage.written(frame, "queries")
    blocks = int(kept.agg(whole).head()[0] // limit) + 1
    if blocks > 1:
        kept = storage.written(kept.withColumn("_block", F.floor(F.rand(7) * blocks)), "blocks")
    for i in range(blocks):
        block = (kept.where(F.col("_block") == i).drop("_block") if blocks > 1 else kept).toArrow()
        if block.num_rows:
            yield block


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists: the rows whose components are all finite, and their components as doubles. Null and empty lists are left out."""
    lists = lists.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)  # a null component is not a number
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = flat[tk.gather(offsets[rows], sizes[rows])].reshape(-1, size)
        fine = np.isfinite(found).all(1)
        yield rows[fine], found[fine]
