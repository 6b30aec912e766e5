"""Ranks with a total order: contiguous positions from 0, ties broken by explicit keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_by(df: DataFrame, by: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """df with its 0-based position within `by`; with a limit only the first rows stay (Spark prunes before the shuffle)."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col(name) <= limit)
    return ranked.withColumn(name, (F.col(name) - 1).cast("int"))


def restrict(rankings: DataFrame, vocabulary: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """Drop codes outside of the vocabulary and close the gaps in the ranks."""
    kept = rankings.join(vocabulary.select(code).distinct(), code, "left_semi")
    return rank_by(kept.withColumnRenamed("rank", "_old"), by, [F.col("_old")]).drop("_old")


def marked(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: whether their (record_id, code) is among those of pairs.

    Pairs meet rows by record, as one set of codes each, so rows that lie by record already are not moved.
    """
    own = pairs.groupBy("record_id").agg(F.collect_set("code").alias("_codes"))
    return rows.join(own, "record_id", "left").withColumn(name, F.coalesce(F.array_contains("_codes", F.col("code")), F.lit(False))).drop("_codes")


def skewed_lookup(rows: DataFrame, found: DataFrame, on: list[str], size: str, total: int, parts: int = 1000) -> DataFrame:
    """rows joined to found, a row a key with its number of rows in `size`, of `total` in all: keys that hold a thousandth of
    the rows or more (so at most `parts`) are broadcast, all others meet in a shuffle join."""
    is_hot = F.col(size) * parts >= F.lit(total)
    hot = F.broadcast(found.where(is_hot))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(found.where(is_hot).select(*on)), on, "left_anti").join(found.where(~is_hot), on))


def numbered(df: DataFrame, order: list[Column], name: str = "position", ranges: int = 1024, each: int = 20) -> DataFrame:
    """df with its 0-based position in an order of unique keys, of any type, without a global sort.

    A sample of at most ranges * each keys, those of smallest hash, gives the bounds of ranges; the counts of the ranges give
    each its first position, and each numbers its own rows. A row finds its range through the first bound of each group of
    bounds and then within its group, some 2 sqrt(ranges) comparisons. Keys that begin alike are told apart by the rest of
    the order.
    """
    keyed = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(ranges * each).agg(F.sort_array(F.collect_list("_key")).alias("s"))
    bounds = sample.select(F.filter("s", lambda _, i: i % each == each - 1).alias("b"))  # one row
    wide = max(1, math.isqrt(ranges))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("b") / wide).cast("int") - 1)), lambda i: F.slice("b", i * wide + 1, wide))
    bounds = bounds.select(groups.alias("_groups")).select("_groups", F.transform("_groups", lambda g: F.try_element_at(g, F.lit(1))).alias("_heads"))
    cut = keyed.join(F.broadcast(bounds)).withColumn("_group", F.expr("size(filter(_heads, h -> h <= _key))"))
    inside = F.expr(f"(_group - 1) * {wide} + size(filter(_groups[_group - 1], b -> b <= _key))")
    cut = cut.withColumn("_range", F.when(F.col("_group") > 0, inside).otherwise(0)).drop("_groups", "_heads", "_group")
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    first = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    placed = cut.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy("_key"))).join(F.broadcast(first), "_range")
    return placed.withColumn(name, F.col("_first") + F.col("_at") - 1).drop("_range", "_first", "_at", "_key")
