"""Precision, recall and F1 at k over rankings and gold sets, in many slices.

Hits are counted once: a record's gold codes meet their best rank, and every k and slice is an aggregate of that table.
Records without gold codes are left out. Official averages round each record's precision and recall half-even to four
places before averaging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def best_ranks(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """record_id, code, min_rank (null if not ranked) for every distinct gold code."""
    ranks = predictions.groupBy("record_id", "code").agg(F.min("rank").alias("min_rank"))
    return gold.select("record_id", "code").distinct().join(ranks, ["record_id", "code"], "left")


def with_k(df: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*(F.lit(k) for k in dict.fromkeys(ks)))))


def record_hits(gold: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """record_id, k, hits, gold (the size of the gold set): one row a record and k, hits of all k from one join."""
    ranks = best_ranks(gold, predictions).groupBy("record_id").agg(
        F.count("*").alias("gold"), *(F.count_if(F.col("min_rank") < k).alias(f"h{k}") for k in dict.fromkeys(ks))
    )
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in dict.fromkeys(ks))))
    return ranks.withColumn("x", each).select("record_id", "x.k", "x.hits", "gold")


def micro(hits: DataFrame, by: list[str]) -> DataFrame:
    """k and the `by` columns with precision, recall, f1, records, assignments over pooled counts."""
    sums = hits.groupBy(*by, "k").agg(F.sum("hits").alias("h"), F.count("*").alias("records"), F.sum("gold").alias("assignments"))
    p, r = F.col("h") / (F.col("records") * F.col("k")), F.col("h") / F.col("assignments")
    return sums.select(*by, "k", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "records", "assignments")


def official(hits: DataFrame, by: list[str]) -> DataFrame:
    """Averages over records of half-even rounded precision and recall, and their rounded F1."""
    each = hits.select(*by, "k", F.bround(F.col("hits") / F.col("k"), 4).alias("p"), F.bround(F.col("hits") / F.col("gold"), 4).alias("r"))
    means = each.groupBy(*by, "k").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.count("*").alias("records"))
    return means.withColumn("f1", F.bround(f1(F.col("precision"), F.col("recall")), 4))


def macro(cells: DataFrame) -> DataFrame:
    """Means over cells, of their F1 as well."""
    return cells.groupBy("k").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count("*").alias("cells"))


def by_band(gold: DataFrame, predictions: DataFrame, bands: DataFrame, names: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """Gold restricted to each band over the same records: band precisions add up to the whole. Empty bands are reported."""
    spark = gold.sparkSession
    ranks = best_ranks(gold, predictions).join(bands.select("code", "band"), "code", "left").withColumn("band", F.coalesce("band", F.lit("zero")))
    n = gold.agg(F.countDistinct("record_id").alias("n"))
    kinds = spark.createDataFrame([(b,) for b in names], "band string")
    sums = ranks.groupBy("band").agg(
        F.count("*").alias("assignments"), F.countDistinct("record_id").alias("records"), *(F.count_if(F.col("min_rank") < k).alias(f"h{k}") for k in ks)
    )
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("hits")) for k in ks)))
    full = F.broadcast(kinds).join(sums, "band", "left").join(F.broadcast(n)).withColumn("x", each)
    hits, k = F.col("x.hits"), F.col("x.k")
    p = hits / (F.col("n") * k)
    r = F.when(F.coalesce("assignments", F.lit(0)) == 0, F.lit(0.0)).otherwise(hits / F.col("assignments"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select("band", k.alias("k"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), count("records"), count("assignments"))


def divergence(micro_all: DataFrame, macro_all: DataFrame) -> DataFrame:
    """macro - micro per k."""
    a, b = macro_all.alias("a"), micro_all.alias("b")
    return a.join(b, "k").select("k", *((F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in ("precision", "recall", "f1")))


def recall_shares(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each cell's share of the summed recall, averaged over all k; equal shares where nothing was recalled."""
    total, n = F.sum("recall").over(W.partitionBy("k")), F.count("*").over(W.partitionBy("k"))
    shares = cells.withColumn("share", F.when(total == 0, 1.0 / n).otherwise(F.col("recall") / total))
    return shares.groupBy(*by).agg(F.avg("share").alias("share"))


def dominant(shares: DataFrame, by: list[str], enough: float = 0.5) -> DataFrame:
    """The shortest prefix, by descending share, whose shares reach `enough`. One row a cell: a small table."""
    order = W.orderBy(F.desc(F.round("share", 9)), *by).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("share").over(order), F.lit(0.0))
    return shares.withColumn("before", before).where(F.col("before") < enough).drop("before")


def agreement(a: DataFrame, b: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """The largest absolute difference between two scorers."""
    joined = a.alias("a").join(b.alias("b"), on)
    return joined.agg(F.max(F.greatest(*(F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")) for m in metrics))).alias("max_difference"), F.count("*").alias("compared"))


def achievable_precision(gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    sizes = gold.distinct().groupBy("record_id").agg(F.count("*").alias("n"))
    return with_k(sizes, ks).groupBy("k").agg(F.avg(F.least("n", "k") / F.col("k")).alias("achievable"))


def before_after(before: DataFrame, after: DataFrame, on: list[str], metrics: tuple[str, ...] = ("precision", "recall")) -> DataFrame:
    """Two metric tables side by side: <metric>_before, _after and _change for each slice."""
    a, b = before.alias("a"), after.alias("b")
    columns = [c for m in metrics for c in (F.col(f"a.{m}").alias(f"{m}_before"), F.col(f"b.{m}").alias(f"{m}_after"), (F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_change"))]
    return a.join(b, on).select(*on, *columns)


def with_overall(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells and a row a k for all of them, the mean of the cells' metrics, named Overall."""
    metrics = ["precision", "recall", "f1"]
    whole = cells.groupBy("k").agg(*(F.avg(m).alias(m) for m in metrics))
    named = whole.select(*(F.lit("Overall" if i == 0 else "").alias(b) for i, b in enumerate(by)), "k", *metrics)
    return cells.select(*by, "k", *metrics).unionByName(named)


def without_gold(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Records that no evaluation counts, as they have no gold codes."""
    return records.select("record_id").join(gold.select("record_id").distinct(), "record_id", "left_anti")


def report(gold: DataFrame, predictions: DataFrame, bands: DataFrame, records: DataFrame, names: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """part, slice, k, precision, recall, f1, records, assignments: pooled, by band, by language and by type. Records without a
    cell are refused."""
    from rankloom.operators.checks import require_none, without_cell

    require_none(without_cell(gold.select("record_id").distinct(), records), "records without a cell")
    own = record_hits(gold, predictions, ks).join(records.select("record_id", "type", "lang"), "record_id")
    named = lambda df, part, column: df.withColumn("part", F.lit(part)).withColumn("slice", column)
    parts = [named(micro(own, []), "micro", F.lit("all")), named(by_band(gold, predictions, bands, names, ks), "band", F.col("band"))]
    parts += [named(micro(own, [c]), part, F.col(c)) for c, part in (("lang", "language"), ("type", "type"))]
    out = ["part", "slice", "k", "precision", "recall", "f1", "records", "assignments"]
    return reduce(DataFrame.unionByName, (df.select(*out) for df in parts))
