import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10):
    ok = []
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in {i: min(u for j, u in ok if j == i) for i, _ in ok}.items():
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ok if i != q and len(u) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def rows(n=300, seed=0):
    rng = random.Random(seed)
    out = [(i, [round(rng.gauss(0, 1), 2) for _ in range(6)], 0) for i in range(n)]
    out += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 0) for i in range(150)]  # one very common vector
    return out + [(5000, None, 0), (5005, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (5010, [float("nan")] * 6, 0), (5015, [float("inf")] * 6, 0), (5020, [], 0), (5025, [1.0, 2.0], 0), (5030, [3.0, -1.0], 0), (None, [1.0] * 6, 0), (7, rows_7(out), 0), (7, [3.0] * 6, 0), (20, [-1.0] * 6, 0), (20, [9.0] * 6, 0)]


def rows_7(out):
    return next(v for i, v, _ in out if i == 7)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "seed_rows": 20, "leaf": 4}, {"seed_rows": 0, "leaf": 1000}, {"shard_rows": 10, "most_cells": 3, "leaf": 2}])
def test_against_brute_force(spark, sizes):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "n", "shard", "score", "rank")}).repartition(3)
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0, **sizes).collect())) == plain(data)


def test_scores_beyond_doubles(spark):
    data = [(i, [2e5 * (i + 1), 3.0 + i], 0) for i in range(12)]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect())) == plain(data, 4)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0)], SCHEMA)
    assert [tuple(r) for r in T.top_k(df, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 3 * 1024 * 1024)]
    assert T.top_k(df.where("vec_id > 5"), F.col("vec_id") % 5 == 0).count() == 0


def clustered(n=600):
    rng = np.random.default_rng(0)
    return np.concatenate([rng.integers(-5, 5, (n // 3, 4)) + c for c in (0, 4000, -4000)]).astype(float)


def test_the_tree_opens_few_nodes():
    vectors = clustered()
    tree = T.BallTree(np.arange(600), vectors, 16)
    assert sorted(tree.ids) == list(range(600)) and len(tree.left) > 60
    for i, child in enumerate(tree.left):  # children divide their parent, and every row lies in its balls
        if child:
            assert (tree.lo[child], tree.hi[child], tree.hi[child + 1]) == (tree.lo[i], tree.lo[child + 1], tree.hi[i])
        assert T.radius(tree.vectors[tree.lo[i] : tree.hi[i]], tree.centres[i]) <= tree.radii[i] + 1e-9
    for q in range(0, 600, 7):
        tree.opened = 0
        ids, s = tree.search(-1, vectors[q], -np.inf, 3)
        assert sorted(zip(-s, ids)) == sorted(zip(-(vectors @ vectors[q]), range(600)))[:3]
        if q >= 200:  # queries far from the origin, where the clusters lie apart
            assert tree.opened < len(tree.left) / 2
    tree.opened = 0
    assert len(tree.search(-1, vectors[250], 1e12, 3)[0]) == 0 and tree.opened == 0  # a k-th score from elsewhere ends the search


def test_cells_that_cannot_reach_the_kth_score_are_not_sent(monkeypatch, spark):
    vectors = clustered()
    seeds = {4: (np.arange(600), vectors)}
    cells = T.Cells(seeds, {4: 600}, 50, 12)
    cell, reach = cells.nearest(vectors)
    cells.measured([(4, c, reach[cell == c].max(), (cell == c).sum(), 4005.0) for c in set(cell.tolist())])
    q = vectors[250]
    low = cells.floor(250, q, 10)
    assert low == sorted(np.delete(vectors, 250, 0) @ q)[-10]
    reached = [c for bound, c in cells.ranked(q) if bound >= low]
    assert 0 < len(reached) < len(set(cell.tolist()))
    best = np.argsort(-(vectors @ q), kind="stable")[:10]
    assert set(cell[best]) <= set(reached)
