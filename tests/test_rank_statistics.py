"""Positions through many ranges, and rank correlations by inversions, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import curves as V
from rankloom.operators.ranking import numbered


def brute(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    n, tx, ty = len(pairs), sum(a == 0 for a, _ in pairs), sum(b == 0 for _, b in pairs)
    return sum(a * b for a, b in pairs) / ((n - tx) * (n - ty)) ** 0.5 if n > tx and n > ty else None


@pytest.mark.parametrize("seed, most, least", [(0, 1024, 65_536), (1, 1024, 9), (2, 4, 1), (3, 7, 5)])
def test_kendall_on_ties(spark, seed, most, least):
    rng = random.Random(seed)
    values = [None, *range(rng.choice([3, 30, 400]))]
    rows = [(rng.choice(values), rng.choice(values)) for _ in range(160)]
    df = spark.createDataFrame([(f"s{i}", x, y) for i, (x, y) in enumerate(rows)], "name string, x long, y long")
    assert V.kendall(df, "name", "x", "y", most, least).first().tau == pytest.approx(brute(rows))


def test_kendall_beyond_what_all_pairs_could_do(spark):
    n = 30_000
    df = spark.range(n).select("id", F.col("id").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") - 2).alias("y"))
    assert 0.999 < V.kendall(df, "id", "x", "y", least=4096).first().tau < 1
    assert V.kendall(df.select("id", "x", (-F.col("x")).alias("y")), "id", "x", "y", least=4096).first().tau == -1.0
    assert V.kendall(df.select("id", "x", F.lit(1).alias("y")), "id", "x", "y").first().tau is None
    assert V.kendall(df.limit(0), "id", "x", "y").first().tau is None


def test_inversions():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 64, 100):
        p = rng.permutation(n)
        assert V.inversions(p) == sum(p[i] > p[j] for j in range(n) for i in range(j))


def test_positions_through_a_thousand_ranges(spark):
    rng = random.Random(6)
    keys = list(range(0, 60_000, 3))
    rng.shuffle(keys)
    df = spark.createDataFrame([(f"k{k:06d}", k % 5) for k in keys], "k string, v int")
    found = numbered(df, [F.col("k")], ranges=1000)
    assert [r.position for r in found.orderBy("k").collect()] == list(range(20_000))
    wide = numbered(df, [F.col("v"), F.col("k")], ranges=7, each=3).orderBy("position").collect()
    assert [(r.v, r.k) for r in wide] == sorted((r.v, r.k) for r in wide)


def test_average_ranks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, 1.0, 2.0, None, 5.0, None])], "id int, v double")
    assert {r.id: r.r for r in V.average_ranks(df, "v", "r").collect()} == {3: 1.5, 5: 1.5, 1: 3.0, 0: 4.5, 2: 4.5, 4: 6.0}
