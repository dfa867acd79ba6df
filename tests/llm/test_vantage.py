"""Nearest by inner product: exact where the bounds are taken once, measured against brute force where they are relaxed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwright.llm import queries, vantage

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=20, asks=lambda i: i % 20 == 0):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for _, v in good), default=0)
    x = np.array([np.pad(v, (0, dims - len(v))) for _, v in good]).reshape(-1, dims)
    ids, out = np.array([i for i, _ in good]), []
    for n, i in enumerate(ids.tolist()):
        if asks(i):
            score = (x * x[n]).sum(axis=1)
            others = np.flatnonzero(np.arange(len(ids)) != n)
            order = others[np.lexsort((ids[others], -score[others]))][:k]
            out += [(i, r, int(ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def found(spark, rows, **more):
    return sorted(map(tuple, vantage.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0", **more).collect()))


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 60), dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.1 * rng.normal(size=(n, dims))) * rng.uniform(0.2, 3, (n, 1))


@pytest.mark.parametrize(("shard", "leaf", "strip"), [(8192, 256, 8192), (150, 8, 16), (60, 4, 7)])
def test_exact_with_a_factor_of_one(spark, monkeypatch, shard, leaf, strip):
    monkeypatch.setattr(vantage, "SHARD", shard)
    monkeypatch.setattr(vantage, "LEAF", leaf)
    monkeypatch.setattr(vantage, "QUERIES", strip)
    for x in (clustered(900, 12), np.random.default_rng(2).normal(size=(700, 24)), np.random.default_rng(3).integers(-1, 2, (600, 4))):
        rows = [(i, v.tolist()) for i, v in enumerate(np.asarray(x, float))]
        got, want = found(spark, rows), plain(rows)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


AWKWARD = [
    (0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0, 2.0]), (1, [0.0, -0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
    (7, [0.5]), (None, [1.0, 1.0]), (8, [-1.0, 3.0]), (8, [-1.0, 3.0]), (60, [2.0, 1.0]), (60, [0.0, 1.0]), (9, [-0.0, 2.0, 0.0]), (80, [0.0, 0.0]), (100, None),
]


def test_awkward_rows(spark):
    assert found(spark, AWKWARD) == plain(AWKWARD)
    assert found(spark, AWKWARD, k=1) == plain(AWKWARD, 1)
    assert found(spark, []) == found(spark, [(20, None)]) == found(spark, [(20, [1.0])]) == []
    extra = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 AS row", "2 AS id", "3 AS vector", "4 AS shard", "5 AS query")
    assert sorted(map(tuple, vantage.nearest(extra, F.col("vec_id") % 20 == 0).collect())) == plain(AWKWARD)


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 40)
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), 1.0]) for i in range(900)] + [(i, [1.0, 2.0]) for i in range(0, 200, 20)]
    assert found(spark, rows) == plain(rows)


def test_relaxed_bounds_skip_branches_and_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 200)
    monkeypatch.setattr(vantage, "LEAF", 16)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000, 32))]
    want = {r[:3:2] for r in plain(rows)}
    kept = [len(want & {r[:3:2] for r in found(spark, rows, relaxed=f)}) / len(want) for f in (1.0, queries.RELAXED)]
    assert kept[0] == 1 and kept[1] >= 0.9


def test_branches_are_skipped():
    """The share of vectors that are looked at falls with the factor."""
    x = vantage._added(clustered(4000, 8), 20.0)
    q = np.concatenate([x[:50, :-1], np.zeros((50, 1))], axis=1)
    tree, seen = vantage.grown(x, np.arange(len(x)), 32), {}

    class Counting(vantage.Search):
        def scan(self, leaf, who):
            seen[self.relaxed] = seen.get(self.relaxed, 0) + len(leaf) * len(who)
            super().scan(leaf, who)

    for relaxed in (1.0, queries.RELAXED):
        Counting(x, tree, q, np.full(50, np.inf), 31, relaxed)
    assert seen[queries.RELAXED] < 0.8 * seen[1.0] < 50 * 4000


def test_recall_of_the_query_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {r[:3:2] for r in plain(rows)}
    got = {r[:3:2] for r in map(tuple, queries.op12_nearest(spark, "/root/testdata/sf0.1").collect())}
    assert len(want & got) / len(want) >= 0.9
