"""The hash-prefix forest against all cosines written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import blocks, forest, queries

NAN, INF = float("nan"), float("inf")


def nearest(rows, asked, k):
    """rows: (id, vector); by exact cosines of vectors of one length, own id left out."""
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in asked:
        if q is not None and good(v):
            near = sorted((-forest.cosine(forest.directions(np.array([v]))[0][0], forest.directions(np.array([w]))[0][0]), i) for i, w in rows if i is not None and i != q and good(w) and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [1.0, None]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [-0.0, 1.0]), (12, [1.0, 1.0, 1.0]), (13, [1e-300, 1e-300]), (14, [1e300, -1e300]), (0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    got = sorted(map(tuple, forest.neighbours(df, df, 3).collect()))
    assert got == nearest(rows, rows, 3)
    assert [r[2] for r in got if r[0] == 1] == [2, 3, 13] and [r[2:] for r in got if r[0] == 0] == [(12, forest.cosine(np.array([1.0, 1, 1]), np.array([1.0, 2, 3])))]


def test_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for a, b in ((empty, empty), (one, empty), (empty, one), (one, one)):
        found = forest.neighbours(a, b)
        assert found.count() == 0 and found.columns == ["query_id", "rank", "vec_id", "score"]


def test_queries_from_outside_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(1).tolist()) for i in range(60)]
    asked = [(1000 + i, rng.standard_normal(8).tolist()) for i in range(30)]
    monkeypatch.setattr(forest, "BLOCK", 7)
    make = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, forest.neighbours(make(rows), make(asked), 4).collect())) == nearest(rows, asked, 4)


def test_a_third_of_all_rows_are_one_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = [tuple(r)[:3] for r in forest.neighbours(df, df.where("vec_id in (0, 300)"), 5).collect()]
    assert sorted(got) == [(0, r + 1, 3 * r + 3) for r in range(5)] + [(300, r + 1, 3 * r) for r in range(5)]


def test_longest_prefixes_come_first_in_all_trees_at_once(monkeypatch):
    """What a query meets is what the plain comparison of its strings with all others gives."""
    monkeypatch.setattr(forest, "TREES", 9)
    monkeypatch.setattr(forest, "LEAST", 30)
    rng = np.random.default_rng(6)
    import pyarrow as pa

    x = rng.standard_normal((700, 16))
    batch = pa.RecordBatch.from_pylist([{"vec_id": i, "embedding": v} for i, v in enumerate(x.tolist())])
    (row,) = forest._grown([batch])
    part = forest.Slice({k: v[0].as_py() for k, v in zip(row.schema.names, row.columns)})
    queries = x[:40] + 0.1
    unit = forest.directions(queries)[1]
    keys = np.stack([forest.strings(unit, t) for t in range(9)])
    own = np.stack([forest.strings(part.unit, t) for t in range(9)])
    least = max(30, 700 // forest.PART)
    for q, met in enumerate(part.met(keys)):
        same = [[next((d for d in range(forest.DIGITS, 0, -1) if k >> (5 * (forest.DIGITS - d)) == o >> (5 * (forest.DIGITS - d))), 0) for o in own[t].tolist()] for t, k in enumerate(keys[:, q].tolist())]
        longest = np.max(same, 0)
        level = max((d for d in range(forest.DIGITS + 1) if (longest >= d).sum() >= least), default=0)
        assert met.tolist() == np.flatnonzero(longest >= level).tolist()


def test_matrices():
    import pyarrow as pa

    lists = pa.array([[1.0, 2.0], None, [], [3.0], [None, 1.0], [4.0, INF], [5.0, 6.0]], pa.list_(pa.float32()))
    assert [(r.tolist(), x.tolist()) for r, x in blocks.matrices(lists.slice(1))] == [([2], [[3.0]]), ([5], [[5.0, 6.0]])]


def test_recall_on_the_table(spark):
    found = queries.op11_hash_prefix_forest(spark, "/root/testdata/check_s").collect()
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toPandas()
    x, ids = np.stack(vectors["v"].to_numpy()), vectors["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, 1)[:, :5]
    want = {(int(ids[q]), int(ids[i])) for q, row in zip(asked, best) for i in row}
    assert len(found) == 5 * len(asked) and len({(r.query_id, r.rank) for r in found}) == len(found)
    at = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12 for r in found)
    assert len(want & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(want)
