"""The relational side of training: hard negatives, examples, batches, masks."""

from __future__ import annotations

import bisect
import heapq
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import marked, rank_by


def hard_negatives(rankings: DataFrame, gold: DataFrame, count: int) -> DataFrame:
    """record_id, code, rank: the first `count` ranked codes that are not gold."""
    wrong = marked(rankings, gold, "gold").where("not gold")
    return rank_by(wrong.select("record_id", "code", F.col("rank").alias("_old")), ["record_id"], [F.col("_old"), F.col("code")], limit=count).drop("_old")


def examples(gold: DataFrame, vocabulary: DataFrame, negatives: DataFrame) -> DataFrame:
    """record_id, positive, negatives (array, in rank order; empty without any): one per gold code in the vocabulary."""
    own = negatives.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x.code).alias("negatives"))
    known = gold.select("record_id", "code").distinct().join(vocabulary.select("code"), "code", "left_semi")
    kind = negatives.schema["code"].dataType.simpleString()
    return known.join(own, "record_id", "left").select("record_id", F.col("code").alias("positive"), F.coalesce("negatives", F.array().cast(f"array<{kind}>")).alias("negatives"))


def filled(positives: list, size: int) -> list[int]:
    """The batch of each pair, taken in the given order: a pair whose positive is in the open batch already waits.

    Those that wait are walked through again, in order, until all are placed; a full batch is closed at once, and one that a
    whole walk adds nothing to is closed as well. Instead of walking past pairs that have to wait, the next pair of
    each positive that is free stands in a heap, so that the work does not grow with how often a positive is repeated.
    """
    waiting: dict = {}
    for i, p in enumerate(positives):
        waiting.setdefault(p, []).append(i)
    out, number, at, open_batch, placed = [0] * len(positives), 0, -1, [], False
    heap = [(own[0], p) for p, own in waiting.items()]
    heapq.heapify(heap)
    while waiting:
        if not heap:  # the walk is over
            if not placed and open_batch:
                number, open_batch = number + 1, []
            at, placed = -1, False
            taken = set(open_batch)
            heap = [(own[0], p) for p, own in waiting.items() if p not in taken]
            heapq.heapify(heap)
            continue
        at, p = heapq.heappop(heap)
        own = waiting[p]
        own.pop(bisect.bisect_left(own, at))
        if not own:
            del waiting[p]
        out[at], placed = number, True
        open_batch.append(p)
        if len(open_batch) == size:
            for q in open_batch:
                later = waiting.get(q, ())
                k = bisect.bisect_right(later, at)
                if k < len(later):
                    heapq.heappush(heap, (later[k], q))
            number, open_batch = number + 1, []
    return out


def batches(pairs: DataFrame, size: int, seed: int, shards: int | None = None, shard_rows: int = 100_000) -> DataFrame:
    """record_id, positive, shard, batch: a seeded shuffle cut so that no batch repeats a positive.

    Filling batches is sequential, so pairs are dealt by hash to independent sequences of about `shard_rows`, or `shards`.
    """
    shards = shards or max(1, -(-pairs.count() // shard_rows))
    own = pairs.select("record_id", "positive").withColumn("shard", F.pmod(F.xxhash64("record_id", "positive"), F.lit(shards)).cast("int"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["record_id", "positive"], kind="stable").reset_index(drop=True)
        order = list(range(len(pdf)))
        random.Random(seed * 1_000_003 + int(pdf["shard"].iloc[0])).shuffle(order)
        pdf = pdf.iloc[order].reset_index(drop=True)
        return pdf.assign(batch=filled(pdf["positive"].tolist(), size))

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("record_id", "positive"))
    return own.groupBy("shard").applyInPandas(cut, f"{kinds}, shard int, batch int")


def batch_facts(cut: DataFrame) -> DataFrame:
    """One row: pairs, distinct pairs, pairs that repeat a positive within a batch, and the largest batch."""
    per = cut.groupBy("shard", "batch").agg(F.count("*").alias("n"), F.countDistinct("positive").alias("positives"))
    pairs = cut.agg(F.count("*").alias("pairs"), F.countDistinct("record_id", "positive").alias("distinct_pairs"))
    return pairs.join(per.agg(F.sum(F.col("n") - F.col("positives")).alias("repeats"), F.max("n").alias("largest")))  # one row each


def columns(positives: Column, negatives: Column) -> Column:
    """A batch's columns: its positives, then new negatives, in order of first appearance."""
    return F.array_distinct(F.concat(positives, negatives))


def batch_columns(rows: DataFrame) -> DataFrame:
    """batch, columns: columns() of each batch of rows(batch, record_id, positive, negatives), in order of record and positive.

    The first place of each code of a batch is found by its key; only then a batch is gathered, a row a code.
    """
    first = rows.select("batch", F.col("positive").alias("code"), F.lit(0).alias("phase"), "record_id", F.lit(0).alias("at"))
    per = rows.groupBy("batch", "record_id").agg(F.any_value("negatives").alias("negatives"))
    later = per.select("batch", F.lit(1).alias("phase"), "record_id", F.posexplode("negatives").alias("at", "code")).select(*first.columns)
    places = first.unionByName(later).groupBy("batch", "code").agg(F.min(F.struct("phase", "record_id", "at")).alias("first"))
    return places.select("batch", "first.*", "code").groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("phase", "record_id", "at", "code"))), lambda x: x.code).alias("columns"))


def false_negatives(rows: DataFrame, scored: DataFrame, gold: DataFrame) -> DataFrame:
    """batch, record_id, positive, code: scored codes of the batch that are gold for the row's record, but not its target."""
    own = rows.select("batch", "record_id", "positive")
    known = own.join(gold.select("record_id", "code").distinct(), "record_id").where(F.col("code") != F.col("positive"))
    return known.join(scored.select("batch", "code").distinct(), ["batch", "code"]).select("batch", "record_id", "positive", "code").distinct()


def mining_stats(negatives: DataFrame, records: DataFrame, enough: int = 4) -> DataFrame:
    """One row: records, the mean number of wrong codes, records with fewer than `enough`."""
    n = records.select("record_id").join(negatives.groupBy("record_id").agg(F.count("*").alias("n")), "record_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.agg(F.count("*").alias("records"), F.avg("n").alias("mean_wrong"), F.count_if(F.col("n") < enough).alias("short"))


def rank_codes(scores: DataFrame, layer: DataFrame, k: int) -> DataFrame:
    """record_id, rank, code from scores(record_id, scores array): highest first, ties by column."""
    flat = scores.select("record_id", F.posexplode("scores").alias("position", "score"))
    top = rank_by(flat, ["record_id"], [F.desc("score"), F.col("position")], limit=k)
    return top.join(layer, "position").select("record_id", "rank", "code", "score")
