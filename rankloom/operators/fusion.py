"""Weighted reciprocal-rank fusion, its subsets and sweeps. Rankings are long: record_id, source, rank, code, score."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import marked, rank_by


class MissingWeight(ValueError):
    """A source without a weight."""


def _weighted(rankings: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(x))) for s, x in weights.items()))
    return rankings.withColumn("weight", F.coalesce(w, F.raise_error(F.concat(F.lit("no weight for source "), F.col("source"))).cast("double")))


def fuse(rankings: DataFrame, weights: dict[str, float], rrf_k: int = 60, limit: int = 100) -> DataFrame:
    """record_id, rank, code, score, sources (map of source to its 0-based rank)."""
    if not weights:
        raise MissingWeight("no weights")
    part = F.col("weight") / (F.lit(rrf_k) + F.col("rank") + 1)
    summed = _weighted(rankings, weights).groupBy("record_id", "code").agg(
        F.sum(part).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "rank")))).alias("sources")
    ).withColumn("score", F.round("score", 9))
    return rank_by(summed, ["record_id"], [F.desc("score"), F.col("code")], limit=limit).select("record_id", "rank", "code", "score", "sources")


def combine(rankings: DataFrame, weights: dict[str, float], rrf_k: int = 60, limit: int = 100) -> DataFrame:
    """fuse(), but a single source keeps its own order and scores."""
    if len(weights) > 1:
        return fuse(rankings, weights, rrf_k, limit)
    own = rankings.where(F.col("source") == next(iter(weights))).where(F.col("rank") < limit)
    return own.select("record_id", "rank", "code", "score", F.create_map("source", "rank").alias("sources"))


def provenance(fused: DataFrame) -> DataFrame:
    """record_id, code, source, source_rank: one row for each list that held the code."""
    return fused.select("record_id", "code", F.explode("sources").alias("source", "source_rank"))


def misaligned(rankings: DataFrame, names: list[str]) -> DataFrame:
    """Records that are not ranked by every source, with the number of sources that rank them."""
    return rankings.groupBy("record_id").agg(F.countDistinct("source").alias("sources")).where(F.col("sources") < len(names))


def subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(1, len(names) + 1) for c in combinations(names, n)]


def fuse_subsets(rankings: DataFrame, weights: dict[str, float], rrf_k: int = 60, limit: int = 50) -> DataFrame:
    """record_id, subset, rank, code, score for every non-empty subset of the sources, in one job."""
    each = F.explode(F.array(*(F.struct(F.lit("+".join(s)).alias("subset"), F.array(*map(F.lit, s)).alias("members")) for s in subsets(sorted(weights)))))
    spread = _weighted(rankings, weights).withColumn("x", each).where(F.array_contains("x.members", F.col("source")))
    score = F.round(F.sum(F.col("weight") / (F.lit(rrf_k) + F.col("rank") + 1)), 9).alias("score")
    summed = spread.groupBy("record_id", F.col("x.subset").alias("subset"), "code").agg(score)
    return rank_by(summed, ["record_id", "subset"], [F.desc("score"), F.col("code")], limit=limit)


def sweep(rankings: DataFrame, gold: DataFrame, grid: list[tuple[dict[str, float], int]], k: int = 10) -> DataFrame:
    """setting, weights, rrf_k, recall, position: recall at k of every setting of weights and rrf_k, best first.

    Rankings and gold meet once, by record; rankings that lie by record already are not moved. A task holds whole records,
    tries all settings on them in numpy, and hands on one count of hits a setting.
    """
    sources = sorted(grid[0][0])
    ranks = rankings.groupBy("record_id", "code").agg(*(F.min(F.when(F.col("source") == s, F.col("rank"))).cast("double").alias(f"r_{s}") for s in sources))
    rows = F.struct("code", "gold", *(f"r_{s}" for s in sources))
    kept = marked(ranks, gold, "gold").groupBy("record_id").agg(F.sort_array(F.collect_list(rows)).alias("x")).select("record_id", F.inline("x"))

    def hits_of(first: np.ndarray, gold_at: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Hits of every setting; first: whether a record begins. Rows are in order of record and code, so stable sorts keep ties by code."""
        ranked = np.flatnonzero(~np.isnan(ranks).all(axis=0))
        record = np.cumsum(first)[ranked]
        starts = np.searchsorted(record, record, "left")
        out = np.zeros(len(grid), np.int64)
        for i, (w, rrf_k) in enumerate(grid):
            score = np.zeros(len(ranked))
            for s, r in zip(sources, ranks):
                score += np.nan_to_num(w[s] / (rrf_k + r[ranked] + 1))
            order = np.lexsort((-np.round(score, 9), record))
            top = np.arange(len(order)) - starts < k  # records are contiguous before and after the sort
            out[i] = gold_at[ranked][order[top]].sum()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        total = np.zeros(len(grid), np.int64)

        def take(table: pa.Table, last: bool) -> pa.Table:
            nonlocal total
            table = table.combine_chunks()
            ids = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            end = len(ids) if last else int(np.flatnonzero(first)[-1])  # the last record may go on in the next batch
            own = table.slice(0, end)
            total += hits_of(first[:end], own.column(2).to_numpy(), [own.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(sources))])
            return table.slice(end)

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rest = take(table if rest is None else pa.concat_tables([rest, table]), False)
        if rest is not None and rest.num_rows:
            take(rest, True)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], ["setting", "hits"])

    sums = kept.mapInArrow(run, "setting int, hits long").groupBy("setting").agg(F.sum("hits").alias("hits"))
    golds = gold.select("record_id", "code").distinct().agg(F.count("*").alias("total"))  # one row
    named = gold.sparkSession.createDataFrame(
        [(i, ",".join(f"{w[s]:g}" for s in sources), rrf_k) for i, (w, rrf_k) in enumerate(grid)], "setting int, weights string, rrf_k int"
    )
    scored = F.broadcast(named).join(sums, "setting", "left").join(F.broadcast(golds)).select(
        "setting", "weights", "rrf_k", F.coalesce(F.try_divide(F.col("hits"), F.col("total")), F.lit(0.0)).alias("recall")
    )
    return rank_by(scored.withColumn("_all", F.lit(0)), ["_all"], [F.desc("recall"), F.col("rrf_k"), F.col("weights")], name="position").drop("_all")


def screen(rankings: DataFrame, fused: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """source, k, hits, recall: each retriever's lists and the fused one, from one retrieval."""
    met = lambda df: marked(df, gold, "hit").where("hit").drop("hit")
    lists = met(rankings.select("record_id", "source", "rank", "code")).unionByName(met(fused.select("record_id", F.lit("fused").alias("source"), "rank", "code")))
    known = gold.select("record_id", "code").distinct()
    hits = lists.groupBy("source").agg(*(F.count_if(F.col("rank") < k).alias(f"h{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks)))
    total = known.agg(F.count("*").alias("total"))
    return hits.withColumn("x", each).join(F.broadcast(total)).select("source", "x.k", "x.hits", (F.col("x.hits") / F.col("total")).alias("recall"))  # one row
