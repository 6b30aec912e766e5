"""Heads fitted together: the optimum of each, one scan an evaluation for all."""

import numpy as np
import pytest

from rankloom.operators import heads as H
from rankloom.operators import prior as P


def rows(spark, seed, n=300, dims=4, groups=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    w = rng.normal(size=(groups, dims)) * 2
    hit = x @ w.T + rng.normal(size=(n, groups)) > rng.normal(size=groups)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    truth = spark.createDataFrame([(int(i), f"g{k}") for i, k in zip(*np.nonzero(hit))] + [(0, "g0"), (10_000, "g1")], "record_id long, group string")
    return x, hit, vectors, truth


def single(spark, vectors, hit, c):
    """One group by the engine's own logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense(v.tolist()), float(h)) for v, h in zip(vectors, hit)], ["features", "label"])
    model = LogisticRegression(regParam=1 / (c * len(hit)), elasticNetParam=0, standardization=False, maxIter=1000, tol=1e-12).fit(data)
    return [*model.coefficients, model.intercept]


@pytest.mark.parametrize("seed, c", [(0, 1.0), (1, 0.2)])
def test_equal_to_one_fit_a_group(spark, seed, c):
    x, hit, vectors, truth = rows(spark, seed)
    hit[0, 0] = True
    head = {r.group: [*r.coefficients, r.intercept] for r in P.fit_head(vectors.repartition(5), truth, [f"g{k}" for k in range(6)], c=c, tolerance=1e-11).collect()}
    for k in range(6):
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ head[f"g{k}"]
        slope = (1 / (1 + np.exp(-z)) - hit[:, k]) @ np.concatenate([x, np.ones((len(x), 1))], axis=1) * c + np.array([*head[f"g{k}"][:-1], 0])
        assert np.abs(slope).max() < 1e-7
    assert head["g2"] == pytest.approx(single(spark, x, hit[:, 2], c), abs=1e-5)


def test_one_scan_serves_all_groups(spark, monkeypatch):
    _, _, vectors, truth = rows(spark, 2, groups=6)
    scans, whole = [], H.sums
    monkeypatch.setattr(H, "sums", lambda data, weights, wanted: scans.append(len(wanted)) or whole(data, weights, wanted))
    P.fit_head(vectors, truth, [f"g{k}" for k in range(6)], tolerance=1e-6)
    assert scans[0] == 6 and len(scans) < 60 and min(scans) < 6  # far fewer than 6 fits of tens of scans; groups that are done leave


def test_groups_without_a_fit(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, vector array<float>")
    truth = spark.createDataFrame([(i, "all") for i in range(4)] + [(1, "other")], "record_id long, group string")
    head = {r.group: (r.coefficients, r.intercept) for r in P.fit_head(vectors, truth, ["all", "none"]).collect()}
    assert head == {"all": ([0.0, 0.0], 20.0), "none": ([0.0, 0.0], -20.0)}
    assert P.fit_head(vectors.limit(0), truth, ["all"]).collect()[0].intercept == -20.0


def test_minimised_finds_quadratic_minima():
    scales, goals = np.array([[1.0, 100.0], [3.0, 0.5], [1.0, 1.0]]), np.array([[1.0, -2.0], [0.0, 5.0], [7.0, 7.0]])
    evaluate = lambda rows, at: ((scales[rows] * (at - goals[rows]) ** 2).sum(axis=1) / 2, scales[rows] * (at - goals[rows]))
    assert np.allclose(H.minimised(evaluate, np.zeros((3, 2)), 1e-10, 200), goals, atol=1e-8)


def test_sums_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 2)
    x, hit, vectors, truth = rows(spark, 3)
    from rankloom.sources.scratch import write_once

    data = write_once(H.labelled(vectors.repartition(7), truth, ["g0", "g1"]), "test-heads")
    loss, slope = H.sums(data, np.zeros((2, 5)), np.array([0, 1]))
    hit[0, 0] = True
    assert loss == pytest.approx([300 * np.log(2)] * 2) and slope[:, -1] == pytest.approx(150 - hit[:, :2].sum(axis=0))
