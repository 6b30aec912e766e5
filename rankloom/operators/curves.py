"""Coverage curves, rank statistics and the comparison of screens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.ranking import numbered, rank_by
from rankloom.operators.rerank import global_position


def coverage_curve(confidences: DataFrame, outcomes: DataFrame, coverages: tuple[float, ...], precision_k: int = 5) -> DataFrame:
    """requested, threshold, records, precision, achievable, recall, share (of assignments), no_hit.

    For each coverage the threshold is the confidence at position min(n, max(1, ceil(c n))); all records at or above it
    stay, whole ties included. outcomes: record_id, hits_p, hits_r, gold.
    """
    import math

    n = confidences.count()
    wanted = [(float(c), min(n, max(1, math.ceil(c * n)))) for c in coverages]
    points = confidences.sparkSession.createDataFrame(wanted, "requested double, wanted int")
    placed = global_position(confidences, "confidence")
    at = placed.join(F.broadcast(points), F.col("position") == F.col("wanted") - 1).select("requested", F.col("confidence").alias("threshold"))
    each = confidences.join(outcomes, "record_id")
    kept = each.join(F.broadcast(at), F.col("confidence") >= F.col("threshold"))  # a row for each requested coverage
    total = F.sum("gold")
    sums = kept.groupBy("requested", "threshold").agg(
        F.count("*").alias("records"), (F.sum("hits_p") / (F.count("*") * precision_k)).alias("precision"),
        F.avg(F.least("gold", F.lit(precision_k)) / precision_k).alias("achievable"), F.try_divide(F.sum("hits_r"), total).alias("recall"),
        total.alias("assignments"), F.avg(F.when(F.col("hits_p") == 0, 1.0).otherwise(0.0)).alias("no_hit"),
    )
    whole = outcomes.agg(F.sum("gold").alias("all"))
    best = F.coalesce(F.try_divide(F.col("precision"), F.col("achievable")), F.lit(0.0))
    return sums.join(F.broadcast(whole)).withColumn("share", F.col("assignments") / F.col("all")).withColumn("share_of_achievable", best).drop("all")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1 in ascending order; ties share the mean of theirs, nulls are one value and come first."""
    spread = F.xxhash64(*df.columns)  # tells rows with one value apart, so that no range holds all of them
    placed = numbered(df.select(F.col(value).alias("_value"), spread.alias("_row")), [F.col("_value"), F.col("_row")], "_place")
    means = placed.groupBy("_value").agg((F.avg("_place") + 1).alias(name))
    return df.join(means, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, null below three points or without variance."""
    ranked = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    flat = (F.count("*") < 3) | (F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0)
    sx, sy, n = F.sum("_rx"), F.sum("_ry"), F.count("*")
    top = n * F.sum(F.col("_rx") * F.col("_ry")) - sx * sy
    bottom = F.sqrt((n * F.sum(F.col("_rx") ** 2) - sx**2) * (n * F.sum(F.col("_ry") ** 2) - sy**2))
    return ranked.agg(F.when(flat, None).otherwise(F.try_divide(top, bottom)).alias("rho"))


def inversions(values: np.ndarray) -> int:
    """How many pairs of different numbers stand in descending order: sorted blocks merge, and each merge counts those across."""
    n, size = len(values), 1
    while size < n:
        size *= 2
    rank = np.concatenate([np.argsort(np.argsort(values, kind="stable"), kind="stable"), np.arange(n, size)])
    total, width = 0, 1
    while width < size:
        pairs = rank.reshape(-1, 2, width)
        base = 2 * size * np.arange(len(pairs))[:, None]
        left, right = (pairs[:, 0] + base).ravel(), (pairs[:, 1] + base).ravel()
        below = np.searchsorted(left, right) - np.repeat(np.arange(len(pairs)) * width, width)
        total += int((width - below).sum())
        rank = np.sort(rank.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    return total


def _within(placed: DataFrame, block: str, other: str | None) -> DataFrame:
    """n: inversions among the rows of each block (columns a, b, px, py), only across values of `other` if it is given."""

    def count(own: dict[str, np.ndarray]) -> int:
        order = np.argsort(own["px"])
        found = inversions(own["py"][order])
        if other is not None:
            side = own[other][order]
            found -= sum(inversions(own["py"][order][side == s]) for s in np.unique(side))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([count({c: whole[c].to_numpy() for c in whole.column_names})], pa.int64())], ["n"])

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(block)).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if keys[lo] != at and held:
                    yield done()
                    held = []
                at = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return placed.select("a", "b", "px", "py").repartition(block).sortWithinPartitions(block).mapInArrow(run, "n long")


def discordant(placed: DataFrame, rows: int, most: int = 1024, least: int = 65_536) -> DataFrame:
    """One row, n: pairs whose positions px and py (both from 0 without gaps) are in opposite order.

    Both orders are cut into at most `most` blocks. Pairs within a block of px are counted by its task, those within a block
    of py and across blocks of px by another, and all others from how many rows each pair of blocks holds.
    """
    block = max(least, -(-rows // most))
    placed = placed.withColumn("a", (F.col("px") / block).cast("long")).withColumn("b", (F.col("py") / block).cast("long"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((most + 1, most + 1), np.int64)
        for batch in batches:
            np.add.at(cells, (batch.column(0).to_numpy(), batch.column(1).to_numpy()), batch.column(2).to_numpy())
        later = np.zeros_like(cells)  # rows in earlier blocks of px and later ones of py
        later[1:, :-1] = cells.cumsum(axis=0)[:-1, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        yield pa.RecordBatch.from_arrays([pa.array([int((cells * later).sum())], pa.int64())], ["n"])

    cells = placed.groupBy("a", "b").agg(F.count("*").alias("rows")).coalesce(1).mapInArrow(across, "n long")  # at most most * most rows
    parts = _within(placed, "a", None).unionByName(_within(placed, "b", "a")).unionByName(cells)
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def kendall(df: DataFrame, key: str, x: str, y: str, most: int = 1024, least: int = 65_536) -> DataFrame:
    """One row: tau-b, null without variance; rows with a null value take no part. n log n work, by inversions."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    n = own.count()
    placed = numbered(numbered(own, [F.col("x"), F.col("y"), F.col("k")], "px"), [F.col("y"), F.col("px")], "py")
    ties = lambda name, *by: own.groupBy(*by).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).alias(name))
    facts = discordant(placed, n, most, least).join(ties("tx", "x")).join(ties("ty", "y")).join(ties("txy", "x", "y"))  # one row each
    pairs = F.lit(n * (n - 1) // 2)
    bottom = F.sqrt(((pairs - F.col("tx")) * (pairs - F.col("ty"))).cast("double"))
    return facts.select(F.try_divide((pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("n")).cast("double"), bottom).alias("tau"))


def screen_ranking(rows: DataFrame, by: list[str], metric: str, name: str) -> DataFrame:
    return rank_by(rows, by, [F.desc(metric), F.col(name)], name="position")


def rank_moves(rows: DataFrame, screen: str, metric: str, name: str, first, last) -> DataFrame:
    """name, before, after, moved between two screens."""
    ranked = screen_ranking(rows, [screen], metric, name)
    at = lambda s, c: ranked.where(F.col(screen) == s).select(name, F.col("position").alias(c))
    return at(first, "before").join(at(last, "after"), name).withColumn("moved", F.col("before") - F.col("after"))


def control_drift(rows: DataFrame, name: str, metric: str) -> DataFrame:
    """Controls, which no index changes, whose value moved all the same."""
    return rows.groupBy(name).agg(F.min(metric).alias("low"), F.max(metric).alias("high")).where("low <> high").withColumn("drift", F.col("high") - F.col("low"))


def attribution(untrained_small: DataFrame, untrained: DataFrame, trained: DataFrame, name: str, metric: str) -> DataFrame:
    """name, index_adds, training_adds."""
    at = lambda df, c: df.select(name, F.col(metric).alias(c))
    joined = at(untrained_small, "a").join(at(untrained, "b"), name).join(at(trained, "c"), name)
    return joined.select(name, (F.col("b") - F.col("a")).alias("index_adds"), (F.col("c") - F.col("b")).alias("training_adds"))


def training_table(untrained: DataFrame, trained: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """name, weights (off the shelf, fine-tuned, added) and the metrics: what training added to each system in both, beside its two rows."""
    at = lambda df, side: df.select(name, F.struct(*metrics).alias(side))
    both = at(untrained, "before").join(at(trained, "after"), name)
    row = lambda label, value: F.struct(F.lit(label).alias("weights"), *(value(m).alias(m) for m in metrics))
    rows = F.array(
        row("off the shelf", lambda m: F.col("before")[m]), row("fine-tuned", lambda m: F.col("after")[m]), row("added", lambda m: F.col("after")[m] - F.col("before")[m])
    )
    return both.select(name, F.explode(rows).alias("x")).select(name, "x.*")


def per_retriever(rows: DataFrame, whole: DataFrame, screens: DataFrame, name: str, metric: str, controls: list[str]) -> DataFrame:
    """name, place (in the ranking of the largest screen), screen, size_place, retriever, value, fused, drifts.

    rows: screen, name, retriever, metric; whole: screen, name, metric of all retrievers together; screens: screen,
    documents. A control, which reads no indexed document, drifts if its value is not the same on all screens.
    """
    sizes = by_index_size(screens).select("screen", F.col("place").alias("size_place"))  # a row a screen
    largest = sizes.agg(F.max_by("screen", "size_place").alias("screen"))
    best = screen_ranking(whole.join(F.broadcast(largest), "screen"), ["screen"], metric, name).select(name, F.col("position").alias("place"))
    held = rows.groupBy(name, "retriever").agg((F.min(metric) != F.max(metric)).alias("moved"))
    own = rows.select("screen", name, "retriever", F.col(metric).alias("value")).join(whole.select("screen", name, F.col(metric).alias("fused")), ["screen", name])
    met = own.join(held, [name, "retriever"]).join(best, name).join(F.broadcast(sizes), "screen")
    return met.select(name, "place", "screen", "size_place", "retriever", "value", "fused", (F.col("retriever").isin(*controls) & F.col("moved")).alias("drifts"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation, null without variance."""
    return df.agg(F.when((F.stddev_pop(x) != 0) & (F.stddev_pop(y) != 0), F.corr(x, y)).alias("pearson"))


def by_index_size(screens: DataFrame) -> DataFrame:
    """screen, documents, place: screens from the smallest index to the largest. A row a screen."""
    own = screens.select("screen", "documents").distinct()
    return own.withColumn("place", (F.row_number().over(W.orderBy("documents", "screen")) - 1).cast("int"))


def verdict(rows: DataFrame, screens: DataFrame, name: str, metric: str) -> DataFrame:
    """One row: smallest and largest screen, whether their rankings are the same, how many systems moved, rho and tau."""
    ordered = by_index_size(screens)
    ends = ordered.agg(F.min_by("screen", "place").alias("smaller"), F.max_by("screen", "place").alias("larger"))
    ranked = screen_ranking(rows, ["screen"], metric, name).join(F.broadcast(ends))  # one row
    side = lambda c, m, p: ranked.where(F.col("screen") == F.col(c)).select(name, F.col(metric).alias(m), F.col("position").alias(p))
    both = side("smaller", "_x", "_before").join(side("larger", "_y", "_after"), name)
    moved = both.agg(F.count_if(F.col("_before") != F.col("_after")).alias("moved")).withColumn("stable", F.col("moved") == 0)
    return ends.join(moved).join(spearman(both, "_x", "_y")).join(kendall(both, name, "_x", "_y"))  # one row each


def incomparable(screens: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """check, detail: why screens can't be compared; empty if they can.

    screens: screen, documents, split, records, corpora, revision. rows: screen, encoder. held: screen, encoder, section,
    value, for what must be equal everywhere. All are small documents.
    """
    found = lambda df, check, detail: df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    out = [found(screens.agg(F.count("*").alias("n")).where("n < 2"), "screens", F.col("n"))]
    per = screens.select("screen").join(rows.groupBy("screen").agg(F.countDistinct("encoder").alias("n")), "screen", "left")
    out.append(found(per.where("coalesce(n, 0) < 2"), "one encoder", F.col("screen")))
    out.append(found(screens.groupBy("documents").count().where("count > 1"), "same index size", F.col("documents")))
    for c in ("split", "records", "corpora", "revision"):
        out.append(found(screens.agg(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias("x")).where("size(x) > 1"), c, F.array_join("x", ", ")))
    n = screens.agg(F.countDistinct("screen").alias("all"))
    some = rows.groupBy("encoder").agg(F.countDistinct("screen").alias("n")).join(F.broadcast(n)).where(F.col("n") < F.col("all"))  # one row
    out.append(found(some, "encoder at some sizes only", F.col("encoder")))
    every = rows.select("screen", "encoder").join(held.select("section").distinct()).join(held, ["screen", "encoder", "section"], "left")
    apart = every.groupBy("section").agg(F.sort_array(F.collect_set(F.coalesce("value", F.lit("-")))).alias("x")).where("size(x) > 1")
    out.append(found(apart, "differs", F.concat_ws(": ", "section", F.array_join("x", ", "))))
    return reduce(DataFrame.unionByName, out)


def screen_table(rows: DataFrame, systems: str, metric: str, screens: list[str]) -> DataFrame:
    """One row a system, one column a screen, and the change from the first to the last."""
    wide = rows.groupBy(systems).pivot("screen", screens).agg(F.max(metric))
    return wide.withColumn("change", F.col(screens[-1]) - F.col(screens[0]))
