"""A stored inverted index of weighted terms, with upper bounds: blocks of entries, read in place by tasks.

build_index() writes it once. A block has about `block` entries in order of their codes, in clusters of `cluster` entries. A
row a term holds the places of the entries that have it, their weights, and each cluster's peak, the largest size of a
weight there; one more row holds the block's codes by place.

An entry's score is at most the sum of |weight in the query| x peak over the query's terms. In a block a query visits clusters from
the highest bound down and stops when none can reach its k-th score. Where there are several blocks it asks the one with
the highest bound first, and then only those that can still reach the k-th score found there. A bound that only ties is
followed, since ties go by code, so the result is that of adding up all postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.blocks import ragged
from rankloom.operators.ranking import rank_by
from rankloom.sources.scratch import discard, write_once

DECIMALS = 6


@dataclass
class LexicalIndex:
    root: str
    blocks: int
    term_type: str
    code_type: str


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges that start at `starts` and have `sizes` places, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _block_rows(block: int, rows: pa.Table, cluster: int) -> Iterator[pa.RecordBatch]:
    """The stored rows of a block from its entries (code, terms, weights), in order of code."""
    codes, lists = rows["code"].combine_chunks(), rows["terms"].combine_chunks()
    offsets, flat = ragged(lists)
    place = np.repeat(np.arange(len(codes)), np.diff(offsets))
    terms = flat.dictionary_encode()
    which, weights = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((place, which))
    which, place, weights = which[order], place[order], weights[order]
    starts = np.searchsorted(which, np.arange(len(terms.dictionary) + 1))
    first = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(place // cluster, prepend=-1) != 0))  # a cluster's first posting in each list
    peaks = np.maximum.reduceat(np.abs(weights), first) if len(first) else weights
    own = np.searchsorted(which[first], np.arange(len(terms.dictionary) + 1))
    names = ["block", "term", "codes", "places", "weights", "clusters", "peaks"]
    n, no_list = len(terms.dictionary), lambda kind: pa.nulls(1, pa.list_(kind))
    whole = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), codes)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, terms.dictionary.type), whole, no_list(pa.int32()), no_list(pa.float64()), no_list(pa.int32()), no_list(pa.float64())], names)
    if n:
        columns = [_lists(place, starts, pa.int32()), _lists(weights, starts, pa.float64()), _lists(place[first] // cluster, own, pa.int32()), _lists(peaks, own, pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int32()), terms.dictionary, pa.nulls(n, pa.list_(codes.type)), *columns], names)


def build_index(weighted: DataFrame, path: str, block: int = 262_144, cluster: int = 64) -> None:
    """Write the index of weighted(entry, code, term, weight)."""
    packed = weighted.groupBy("entry", "code").agg(F.sort_array(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight")))).alias("p"))
    packed = write_once(packed.select("entry", "code", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")), "lexical-entries")
    blocks = max(1, -(-packed.count() // block))
    kind = {c: packed.schema[c].dataType.simpleString() for c in ("code", "terms")}
    term_type = kind["terms"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if own[a] != at and held:
                    yield from _block_rows(at, pa.Table.from_batches(held), cluster)
                    held = []
                at = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _block_rows(at, pa.Table.from_batches(held), cluster)

    dealt = packed.select(F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"), "code", "terms", "weights", "entry")
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "code", "entry").drop("entry")
    schema = f"block int, term {term_type}, codes array<{kind['code']}>, places array<int>, weights array<double>, clusters array<int>, peaks array<double>"
    dealt.mapInArrow(run, schema).write.partitionBy("block").parquet(f"{path}/lists")
    weighted.sparkSession.createDataFrame([(blocks, term_type, kind["code"])], "blocks int, term_type string, code_type string").coalesce(1).write.parquet(f"{path}/facts")
    discard(packed)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(path, *spark.read.parquet(f"{path}/facts").first())


class Block:
    """One block's lists, as they are stored. `read` counts the postings that queries have read."""

    def __init__(self, rows: pa.Table, cluster: int = 64):
        has_term = pc.is_valid(rows["term"])
        head, lists = rows.filter(pc.invert(has_term)), rows.filter(has_term).combine_chunks()
        self.codes_by_place = head["codes"].combine_chunks().flatten()
        distinct = self.codes_by_place.unique()
        self.codes = distinct.take(pc.sort_indices(distinct))
        self.code_of = pc.index_in(self.codes_by_place, value_set=self.codes).to_numpy(zero_copy_only=False)
        column = lambda c: lists[c].combine_chunks() if lists.num_rows else pa.array([], rows.schema.field(c).type)
        self.terms = column("term")
        (self.starts, places), (_, weights), (self.own, clusters), (_, peaks) = (ragged(column(c)) for c in ("places", "weights", "clusters", "peaks"))
        self.places, self.weights, self.clusters, self.peaks = (x.to_numpy(zero_copy_only=False) for x in (places, weights, clusters, peaks))
        self.size, self.n_clusters = len(self.code_of), -(-len(self.code_of) // cluster)
        # Where each cluster's postings begin in its list: a cluster's run ends where the next one's, or the list, does
        which = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        fresh = (np.diff(which, prepend=-1) != 0) | (np.diff(self.places // cluster, prepend=-1) != 0)
        self.first = np.flatnonzero(fresh)
        self.run = np.diff(np.append(self.first, len(self.places)))
        self.read = 0

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(code place, score) of the k best codes, by their best entry; score rounded, ties to the smaller code."""
        n = self.own[terms + 1] - self.own[terms]
        part = spread(self.own[terms], n)  # the query's (term, cluster) pairs
        cluster, weight = self.clusters[part], np.repeat(weights, n)
        bound = np.bincount(cluster, np.abs(weight) * self.peaks[part], self.n_clusters)
        bound = bound * (1 + 1e-9) + 10.0**-DECIMALS
        met = np.unique(cluster)
        turn = met[np.argsort(-bound[met], kind="stable")]
        scores, kth, at, step = np.full(len(self.codes), -np.inf), -np.inf, 0, 16 if prune else len(turn)
        while at < len(turn) and bound[turn[at]] >= kth:
            visit = np.zeros(self.n_clusters, bool)
            visit[turn[at : at + step]] = True
            hit = visit[cluster]
            size = self.run[part[hit]]
            entry = spread(self.first[part[hit]], size)
            self.read += len(entry)
            places = self.places[entry]
            total = np.bincount(places, self.weights[entry] * np.repeat(weight[hit], size), self.size)
            some = np.flatnonzero(np.bincount(places, minlength=self.size))
            np.maximum.at(scores, self.code_of[some], np.round(total[some], DECIMALS))
            if np.isfinite(scores).sum() >= k:
                kth = -np.partition(-scores, k - 1)[k - 1]
            at += step
            step *= 2
        found = np.flatnonzero(np.isfinite(scores))
        top = found[np.lexsort((found, -scores[found]))[:k]]
        return top, scores[top]


def weighed(rows: pa.RecordBatch, terms_at: int, weights_at: int | None, how: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row the places of its terms in the flat list, and the weights that they have in the query (repeats put together)."""
    offsets, values = ragged(rows.column(terms_at))
    ids = values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    given = rows.column(weights_at).flatten().to_numpy(zero_copy_only=False) if how == "given" else None
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if how == "given":
            yield np.arange(a, b), given[a:b]
        else:
            _, first, counts = np.unique(ids[a:b], return_index=True, return_counts=True)
            yield a + first, np.sqrt(counts) if how == "root" else np.ones(len(first))


def _answered(index: LexicalIndex, asked: DataFrame, k: int, how: str, prune: bool) -> DataFrame:
    """query, code, score of asked(block, query, terms[, weights])."""
    root, query_type = index.root, asked.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        files, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if own[a] != at:
                    at, folder = int(own[a]), f"{base}/lists/block={int(own[a])}"
                    there = files.get_file_info(folder).type == pyarrow.fs.FileType.Directory  # a block that no entry fell into has none
                    block = Block(pq.read_table(folder, filesystem=files, partitioning=None)) if there else None
                if block is None:
                    continue
                rows = batch.slice(a, b - a)
                ids = pc.fill_null(pc.index_in(ragged(rows.column(2))[1], value_set=block.terms), -1).to_numpy(zero_copy_only=False)
                which, codes, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for q, (place, weights) in enumerate(weighed(rows, 2, 3, how)):
                    known = ids[place] >= 0
                    if known.any():
                        found, score = block.best(ids[place][known], weights[known], k, prune)
                        which.append(np.full(len(found), q))
                        codes.append(found)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(np.concatenate(which))), block.codes.take(pa.array(np.concatenate(codes))), pa.array(np.concatenate(scores))], ["query", "code", "score"])

    return asked.mapInArrow(run, f"query {query_type}, code {index.code_type}, score double")


def bounds(index: LexicalIndex, queries: DataFrame, how: str) -> DataFrame:
    """query, block, bound: what no entry of the block can exceed for the query; blocks that share no term with it are left out."""
    columns = ["query", "terms", *(["weights"] if how == "given" else [])]
    query_type = queries.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = ragged(batch.column(1))[1]
            for q, (place, weights) in enumerate(weighed(batch, 1, 2, how)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(place), q))), flat.take(pa.array(place)), pa.array(np.abs(weights))], ["query", "term", "w"])

    terms = queries.select(*columns).mapInArrow(run, f"query {query_type}, term {index.term_type}, w double")
    peaks = queries.sparkSession.read.parquet(f"{index.root}/lists").where("term is not null").select("block", "term", F.array_max("peaks").alias("peak"))
    return terms.join(peaks, "term").groupBy("query", "block").agg((F.sum(F.col("w") * F.col("peak")) * (1 + 1e-9) + 10.0**-DECIMALS).alias("bound"))


def search(index: LexicalIndex, queries: DataFrame, k: int, how: str = "given", prune: bool = True) -> DataFrame:
    """query, code, score, rank of queries(query, terms[, weights]): each query's k best codes."""
    columns = ["query", "terms", *(["weights"] if how == "given" else [])]
    cores = queries.sparkSession.sparkContext.defaultParallelism
    slots = max(1, -(-2 * cores // index.blocks))

    def answered(asked: DataFrame) -> DataFrame:
        dealt = asked.select(F.col("block").cast("int").alias("block"), *columns).repartition(index.blocks * slots, "block", F.pmod(F.xxhash64("query"), F.lit(slots)))
        return _answered(index, dealt.sortWithinPartitions("block"), k, how, prune)

    asked = queries.select(*columns)
    if index.blocks == 1:
        found = answered(asked.withColumn("block", F.lit(0)))
    elif not prune:
        found = answered(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1)))))
    else:
        turn = F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block"))
        turns = write_once(bounds(index, asked, how).withColumn("turn", turn), "lexical-bounds")
        near = write_once(answered(asked.join(turns.where("turn = 1"), "query")), "lexical-near")
        kth = rank_by(near.groupBy("query", "code").agg(F.max("score").alias("score")), ["query"], [F.desc("score"), F.col("code")], limit=k)
        kth = kth.where(F.col("rank") == k - 1).select("query", F.col("score").alias("known"))
        rest = turns.where("turn > 1").join(kth, "query", "left").where("known is null or bound >= known")
        found = near.unionByName(answered(asked.join(rest, "query")))
    best = found.groupBy("query", "code").agg(F.max("score").alias("score"))  # a code's entries may lie in several blocks
    return rank_by(best, ["query"], [F.desc("score"), F.col("code")], limit=k)
