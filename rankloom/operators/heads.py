"""All heads at once: one logistic regression a group, fitted together from one scan of the vectors an evaluation.

The parameters are a matrix of groups by dimensions (and an intercept). For every trial the tasks work out each group's loss and
gradient over their Arrow batches as two matrix products; the sums of tasks are added up in two steps, so what reaches the
driver is at most FAN matrices. L-BFGS runs for all groups side by side, each with its own step and history, and groups that
have converged take no further part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32


def labelled(vectors: DataFrame, truth: DataFrame, groups: list[str]) -> DataFrame:
    """v and ks (numbers of the groups that the row belongs to) of vectors(id, vector) and truth(record_id, group)."""
    names = vectors.sparkSession.createDataFrame([(g, k) for k, g in enumerate(groups)], "group string, k int")
    own = truth.join(F.broadcast(names), "group").groupBy(F.col("record_id").alias("id")).agg(F.collect_set("k").alias("ks"))  # at most one a group
    v = F.transform("vector", lambda x: x.cast("double")).alias("v")
    return vectors.select("id", v).join(own, "id", "left").select("v", F.coalesce("ks", F.array().cast("array<int>")).alias("ks"))


def sums(data: DataFrame, weights: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of the groups `wanted` (their numbers in ks), summed over all rows, at weights (a row a group, intercept last)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(int(wanted.max()) + 1, -1)
        place[wanted] = np.arange(len(wanted))
        out = np.zeros((len(wanted), weights.shape[1] + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ks, size = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            row, known = np.repeat(np.arange(batch.num_rows), size), ks < len(place)
            row, k = row[known], place[ks[known]]
            y = np.zeros((batch.num_rows, len(wanted)))
            y[row[k >= 0], k[k >= 0]] = 1
            z = x @ weights[:, :-1].T + weights[:, -1]
            error = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
            out[:, 0] += (np.logaddexp(0, z) - y * z).sum(axis=0)
            out[:, 1:-1] += error.T @ x
            out[:, -1] += error.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for own in batch.column(1).to_pylist():
                own = np.frombuffer(own)
                out = own.copy() if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    rows = data.mapInArrow(partial, "part int, sums binary")
    if len(data.inputFiles()) > FAN:  # more tasks than the driver should hold matrices of
        rows = rows.repartition(FAN, "part").mapInArrow(total, "part int, sums binary")
    found = sum((np.frombuffer(r.sums) for r in rows.select("sums").collect()), np.zeros(len(wanted) * (weights.shape[1] + 1)))
    found = found.reshape(len(wanted), -1)
    return found[:, 0], found[:, 1:]


def minimised(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, tolerance: float, iterations: int, memory: int = 12) -> np.ndarray:
    """The minima of independent smooth convex functions, one a row of x, by L-BFGS with halved steps.

    evaluate(rows, points) gives the values and gradients of those rows' functions at their points.
    """
    rows = np.arange(len(x))
    value, slope = evaluate(rows, x)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (s, y, 1 / s.y or 0), a row a function
    dot = lambda a, b: (a * b).sum(axis=1, keepdims=True)
    for _ in range(iterations):
        open_ = np.abs(slope).max(axis=1) > tolerance
        if not open_.any():
            break
        q, pulls = slope.copy(), []
        for s, y, rho in reversed(steps):
            pulls.append(rho * dot(s, q))
            q -= pulls[-1] * y
        scale = np.ones((len(x), 1)) / np.maximum(1, np.sqrt(dot(slope, slope)))
        for s, y, rho in steps:  # the latest usable pair scales
            scale = np.where(rho > 0, dot(s, y) / np.maximum(dot(y, y), 1e-300), scale)
        q *= scale
        for (s, y, rho), pull in zip(steps, reversed(pulls)):
            q += (pull - rho * dot(y, q)) * s
        down = dot(q, slope)
        q = np.where(down > 0, q, slope)
        down = np.where(down > 0, down, dot(slope, slope))[:, 0]
        size, todo = np.ones(len(x)), rows[open_]
        new_x, new_value, new_slope = x.copy(), value.copy(), slope.copy()
        for _ in range(40):
            at = x[todo] - size[todo, None] * q[todo]
            v, g = evaluate(todo, at)
            flat = np.abs(value[todo]) * 1e-14  # rounding of the value itself
            good = v <= value[todo] - 1e-4 * size[todo] * down[todo] + flat
            took = todo[good]
            new_x[took], new_value[took], new_slope[took] = at[good], v[good], g[good]
            todo = todo[~good]
            if not len(todo):
                break
            size[todo] /= 2
        s, y = new_x - x, new_slope - slope
        curve = dot(s, y)
        steps = [*steps[1 - memory :], (s, y, np.where(curve > 1e-300, 1 / np.maximum(curve, 1e-300), 0))]
        x, value, slope = new_x, new_value, new_slope
    return x


def fit(data: DataFrame, groups: list[str], c: float, iterations: int, tolerance: float) -> list[tuple[str, list[float], float]]:
    """(group, coefficients, intercept) from data(v, ks); groups that all rows or none belong to get no coefficients and +-20."""
    n, size = data.agg(F.count("*"), F.max(F.size("v"))).first()
    hits = {r.k: r["count"] for r in data.select(F.explode("ks").alias("k")).groupBy("k").count().collect()}  # at most one a group
    free = np.array([k for k in range(len(groups)) if 0 < hits.get(k, 0) < n], int)
    found = np.zeros((len(groups), (size or 0) + 1))
    found[:, -1] = [20.0 if n and hits.get(k, 0) == n else -20.0 for k in range(len(groups))]
    if len(free):

        def evaluate(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            loss, slope = sums(data, at, free[rows])
            own = at[:, :-1]
            pull = np.concatenate([own, np.zeros((len(at), 1))], axis=1)
            return loss / n + (own**2).sum(axis=1) / (2 * c * n), slope / n + pull / (c * n)

        share = np.array([hits[k] / n for k in free])
        start = np.zeros((len(free), found.shape[1]))
        start[:, -1] = [math.log(p / (1 - p)) for p in share]
        found[free] = minimised(evaluate, start, tolerance, iterations)
    return [(g, row[:-1].tolist(), float(row[-1])) for g, row in zip(groups, found)]
