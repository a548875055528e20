"""Clustering with heaps of gaps against plain rounds in whole numbers."""

import hashlib
from math import floor

import numpy as np
import pytest

from gleanery.llm import heaps


def plain(rows, k, rounds, dims, salt):
    kept = [(i, [floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 65536 for x in v)]
    digest = lambda i: hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))[:k]
    centroids = [list(v) for _, v in starts]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if inside := [v for (_, v), c in zip(kept, own) if c == j]:
                centroids[j] = [sum(x) // len(inside) for x in zip(*inside)]
    own = assign() if kept else []
    each = [far(v, centroids[c]) for (_, v), c in zip(kept, own)]
    return sorted(((i, c, d, sum(e for e, o in zip(each, own) if o == c), sum(each), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, own, each)), key=str)


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as ids").repartition(parts)
    return sorted((tuple(r) for r in heaps.cluster(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_rounds(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(heaps, "BLOCK", 17)
    dims, k = (3, 4) if seed % 2 else (2, 8)
    rows = [(i, (rng.integers(0, 6, dims) / 2 + (rng.standard_normal(dims) / 50 if seed < 2 else 0)).tolist()) for i in range(160)]
    rows += [(1000 + i, [1.0] * dims) for i in range(90)] + [(5, [0.25] * dims), (None, [2.0] * dims)]
    rows += [(2000, None), (2001, []), (2002, [1.0]), (2003, [None] * dims), (2004, [float("nan")] * dims), (2005, [float("inf")] * dims), (2006, [65536.0] * dims), (2007, [-65535.5] * dims)]
    more = {"k": k, "rounds": 6, "dims": dims, "salt": f"{seed}:"}
    assert run(spark, rows, **more) == plain(rows, **more)


def test_few_and_none(spark):
    more = {"k": 8, "rounds": 3, "dims": 2, "salt": "3:"}
    assert run(spark, [], parts=1, **more) == [] and run(spark, [(1, None)], parts=1, **more) == []
    for rows in ([(1, [0.5, -0.5])], [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [9.0, 9.0])]):
        assert run(spark, rows, parts=1, **more) == plain(rows, **more)


def test_few_vectors_are_compared_again():
    """On clusters that stand apart, later rounds pop a small part of the heaps, and never miss a vector that changes."""
    rng = np.random.default_rng(9)
    x = (rng.integers(0, 8, (3000, 1)) * 9000 + rng.normal(0, 300, (3000, 16))).astype("<i4")
    row = heaps._row(list(range(3000)), x, np.full(3000, -1), [], np.zeros(0, np.int64), 0)
    block = heaps.Block({k: v[0].as_py() for k, v in zip(row.schema.names, row.columns)}, 8, 16)
    centroids, drift, compared = x[:8].astype(np.int64).tolist(), [0.0] * 8, []
    for _ in range(10):
        moved, n = block.assign(np.array(centroids), drift)
        compared.append(n)
        far = ((x[:, None].astype(np.int64) - np.array(centroids)[None]) ** 2).sum(2)
        assert (block.nearest == far.argmin(1)).all()
        new = [(x[block.nearest == c].astype(np.int64).sum(0) // (block.nearest == c).sum()).tolist() if (block.nearest == c).any() else centroids[c] for c in range(8)]
        drift, centroids = [a + b for a, b in zip(drift, heaps.moves(centroids, new))], new
        assert sum(map(len, block.heaps)) == 3000
    assert compared[0] == 3000 and sum(compared[1:]) < 0.15 * 9 * 3000
