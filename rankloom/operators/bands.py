"""Frequency bands of codes: freezing them, lookups, migration between corpora, and what no corpus can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import numbered

#: Boundaries fixed by the task: band, least count, greatest count (None: no end).
BOUNDARIES = (("head", 101, None), ("torso", 10, 100), ("tail", 1, 9), ("zero", 0, 0))


def band_of(count: Column, boundaries=BOUNDARIES) -> Column:
    """The first band whose range holds the count, else zero."""
    found = F.lit(None).cast("string")
    for band, low, high in reversed(boundaries):
        fits = (count >= low) if high is None else count.between(low, high)
        found = F.when(fits, F.lit(band)).otherwise(found)
    return F.coalesce(found, F.lit("zero"))


def assignment_counts(raw: DataFrame) -> DataFrame:
    """code, count of assignments; repeats inside a record count."""
    return raw.groupBy("code").agg(F.count("*").alias("count"))


def corpus_counts(assignments: DataFrame) -> DataFrame:
    """code, count of records; a record counts once."""
    return assignments.select("record_id", "code").distinct().groupBy("code").agg(F.count("*").alias("count"))


def freeze_bands(raw: DataFrame, boundaries=BOUNDARIES) -> DataFrame:
    return assignment_counts(raw).withColumn("band", band_of(F.col("count"), boundaries))


def weighted_report(frozen: DataFrame) -> DataFrame:
    """band, labels, assignments: how many labels a band has, and how often they are assigned."""
    return frozen.groupBy("band").agg(F.count("*").alias("labels"), F.sum("count").alias("assignments"))


def migration(labels: DataFrame, frozen: DataFrame, counts: DataFrame, boundaries=BOUNDARIES, weight: str | None = None) -> DataFrame:
    """before, after, n: labels by their frozen band and the band that `counts` would give them, weighted by a column of labels."""
    joined = labels.join(frozen.select("code", F.col("band").alias("before")), "code", "left").join(counts.select("code", "count"), "code", "left")
    after = band_of(F.coalesce("count", F.lit(0)), boundaries)
    n = F.sum(weight) if weight else F.count("*")
    return joined.groupBy(F.coalesce("before", F.lit("zero")).alias("before"), after.alias("after")).agg(n.alias("n"))


def unreachable(moved: DataFrame) -> DataFrame:
    return moved.where("before = 'zero' and after = 'zero'")


def migration_report(labels: DataFrame, frozen: DataFrame, counts: DataFrame) -> DataFrame:
    """weighting (label or assignment), band, total, reached, still_zero: of each frozen band the labels that an index of `counts`
    reaches and those it doesn't, once a vote a label, once weighted by labels(code, weight)."""
    joined = labels.join(frozen.select("code", "band"), "code", "left").join(counts.select("code", "count"), "code", "left")
    band, reached = F.coalesce("band", F.lit("zero")).alias("band"), F.coalesce("count", F.lit(0)) > 0
    each = joined.select(band, reached.alias("reached"), F.explode(F.create_map(F.lit("label"), F.lit(1).cast("long"), F.lit("assignment"), F.col("weight").cast("long"))).alias("weighting", "n"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("weighting", "band").agg(F.sum("n").alias("total"), some(F.col("reached")).alias("reached"), some(~F.col("reached")).alias("still_zero"))


def zero_shot_bound(gold: DataFrame, frozen: DataFrame, counts: DataFrame, boundaries=BOUNDARIES) -> DataFrame:
    """One row: labels and assignments that were zero-shot, those an index of `counts` reaches, those it can't, and their share of all gold."""
    weights = corpus_counts(gold).withColumnRenamed("count", "weight")
    joined = weights.join(frozen.select("code", "band"), "code", "left").join(counts.select("code", "count"), "code", "left")
    zero = F.coalesce("band", F.lit("zero")) == "zero"
    reached = zero & (F.coalesce("count", F.lit(0)) > 0)
    lost = zero & (F.coalesce("count", F.lit(0)) == 0)
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    return joined.agg(
        F.count_if(zero).alias("zero_labels"), sums(zero).alias("zero_assignments"), F.count_if(reached).alias("reached_labels"),
        sums(reached).alias("reached_assignments"), F.count_if(lost).alias("lost_labels"), sums(lost).alias("lost_assignments"),
        F.coalesce(F.try_divide(sums(lost), F.sum("weight")), F.lit(0.0)).alias("lost_share"),
    )


def zero_shot_halves(gold: DataFrame, frozen: DataFrame, counts: DataFrame) -> DataFrame:
    """code, half (reached or lost) for the gold labels that were zero-shot."""
    labels = gold.select("code").distinct().join(frozen.where("band <> 'zero'").select("code"), "code", "left_anti")
    return labels.join(counts.where("count > 0").select("code", F.lit("reached").alias("half")), "code", "left").select("code", F.coalesce("half", F.lit("lost")).alias("half"))


def recall_over(labels: DataFrame, gold: DataFrame, predictions: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """half, k, hits, assignments, recall over gold restricted to labels(code, half)."""
    from rankloom.operators.evaluation import best_ranks

    own = best_ranks(gold, predictions).join(labels, "code")
    sums = own.groupBy("half").agg(F.count("*").alias("assignments"), *(F.count_if(F.col("min_rank") < k).alias(f"h{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks)))
    return sums.withColumn("x", each).select("half", "x.k", "x.hits", "assignments", (F.col("x.hits") / F.col("assignments")).alias("recall"))


def output_layer(assignments: DataFrame) -> DataFrame:
    """code, position: the sorted distinct codes, of any type, numbered without gathering them in one task."""
    return numbered(assignments.select("code").distinct(), [F.col("code")]).select("code", "position")


def target_rows(gold: DataFrame, layer: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, columns (sorted positions of its known codes; empty if none)."""
    known = gold.select("record_id", "code").distinct().join(layer, "code").groupBy("record_id").agg(F.sort_array(F.collect_list("position")).alias("columns"))
    return records.select("record_id").join(known, "record_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<bigint>")))


def unreachable_assignments(gold: DataFrame, layer: DataFrame) -> DataFrame:
    """One row: total assignments and those whose code has no column."""
    joined = gold.select("record_id", "code").join(layer.select("code", F.lit(1).alias("known")), "code", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("unreachable"))


def coverage(assignments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: distinct codes used, those in the vocabulary, those unknown to it."""
    used = assignments.select("code").distinct().join(vocabulary.select("code", F.lit(1).alias("known")), "code", "left")
    return used.agg(F.count("*").alias("used"), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))
