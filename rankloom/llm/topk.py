"""Exact top-k inner-product search: ball trees per shard, branch and bound, and a k-th score that shards share.

A ball tree over a sample of at most `seed_rows` vectors has at most `most_cells` leaves; every vector goes to the nearest of
their centres, its cell. Cells with more than `shard_rows` vectors are dealt by hash into shards, so a cell may hold any
share of the rows. Each shard's task builds its own ball tree: nodes split at the median of the widest direction down to
`leaf` vectors, each with centre, radius and smallest id. For a query q a node's best possible inner product is
q . centre + |q| * radius; nodes are opened in descending order of that bound, from the root down, until it falls below the
current k-th score. Queries stream through a task.

A query's k-th score is handed on: it starts from the sample, where k of the vectors are a true lower bound. A first round
sends each query to the cell with its highest bound alone, and what it finds there raises its k-th score. The second round
sends it to those of the other cells whose ball, at most `most_cells` of a size that the driver holds, can still reach that
score; cells that can't are never sent the query. Each shard returns at most k rows a query, and a last ranking merges them.

Scores are exact integers (doubles where they hold them, Python integers beyond; past a long they are returned as its
limits). Bounds are floats widened by a relative error margin, so pruning never drops a result; a node that only ties the
k-th score is opened if its smallest id is below the id that holds that place. Where doubles don't hold the products of a
vector length, cells of that length are not pruned.

Cases: a null vector and one with null or non-finite components takes no part; vectors of another length than the query's
are not comparable and are left out of its results; ties go to the smaller id; queries never match rows with their own id;
rows that repeat an id are candidates of their own, and of rows that repeat a query's id the least vector asks; null ids
take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import column, forget, materialise, table
from rankloom.llm.textbatch import map_arrow

SAFE = 1 << 62


def floored(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as a double, null if a component is null or not finite."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: floor_double(x.cast("double") * factor)))


def floor_double(x: Column) -> Column:
    """floor() that stays a double: components beyond a long keep their value, which has no fraction there."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


class BallTree:
    """A ball tree in flat arrays: node i covers rows lo[i] to hi[i] and has children left[i] and left[i] + 1, or none (0)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order, lo, hi, left = np.arange(len(ids)), [0], [len(ids)], [0]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            if b - a > leaf:
                own = vectors[order[a:b]]
                spread = own.max(axis=0) - own.min(axis=0)
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], m)]
                left[at] = len(lo)
                lo += [a, a + m]
                hi += [a + m, b]
                left += [0, 0]
            at += 1
        self.ids, self.vectors, self.lo, self.hi, self.left = ids[order], vectors[order], lo, hi, left
        spans = list(zip(lo, hi))
        self.centres = np.array([self.vectors[a:b].mean(axis=0) for a, b in spans])
        self.radii = np.array([radius(self.vectors[a:b], c) for (a, b), c in zip(spans, self.centres)])
        self.least = [int(self.ids[a:b].min()) for a, b in spans]
        self.top, self.opened = float(np.abs(vectors).max(initial=0)), 0

    def search(self, qid: int, query: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the query's best k here among those that reach its floor, opening the best node first."""
        scores, ids, kth, last = np.empty(0), np.empty(0, np.int64), floor, SAFE
        norm, size = float(np.sqrt(query @ query)), np.abs(query)
        heap = [(-float(upper(self.centres[:1], self.radii[:1], query, norm, size)[0]), 0)]
        while heap and -heap[0][0] >= kth:
            bound, node = heapq.heappop(heap)
            if np.floor(-bound) <= kth and self.least[node] > last:
                continue
            self.opened += 1
            child = self.left[node]
            if child:
                for i, x in enumerate(upper(self.centres[child : child + 2], self.radii[child : child + 2], query, norm, size).tolist()):
                    if x >= kth:
                        heapq.heappush(heap, (-x, child + i))
                continue
            a, b = self.lo[node], self.hi[node]
            s = self.vectors[a:b] @ query
            keep = (s >= kth) & (self.ids[a:b] != qid)
            if keep.any():
                scores, ids = np.concatenate([scores, s[keep]]), np.concatenate([ids, self.ids[a:b][keep]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth, last = max(kth, float(scores[-1])), int(ids[-1])
        return ids, scores


def radius(vectors: np.ndarray, centre: np.ndarray) -> float:
    return float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))


def upper(centres: np.ndarray, radii: np.ndarray, query: np.ndarray, norm: float, size: np.ndarray) -> np.ndarray:
    """No vector within a ball has a larger inner product with the query; rounding errors included."""
    reach = norm * radii
    return centres @ query + reach + 1e-9 * (np.abs(centres) @ size + reach) + 1e-6


def exact(top: float, query: np.ndarray) -> bool:
    """Whether inner products with vectors of components up to `top` are exact in doubles."""
    return top * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2.0**53


def slow_search(ids: np.ndarray, vectors: np.ndarray, qid: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The same in Python integers, for components so large that doubles would round."""
    q = [int(x) for x in query]
    best = heapq.nsmallest(k, ((-sum(a * int(b) for a, b in zip(q, v)), i) for i, v in zip(ids.tolist(), vectors) if i != qid))
    return [i for _, i in best], [max(-(1 << 63), min(-s, (1 << 63) - 1)) for s, _ in best]


class Cells:
    """The balls that vectors of each length are dealt to: centres from a sample, then radii and sizes from all rows."""

    def __init__(self, seeds: dict[int, tuple[np.ndarray, np.ndarray]], rows: dict[int, int], shard_rows: int, most_cells: int):
        self.seeds, self.shard_rows = seeds, shard_rows
        self.centres = {}
        for n, (ids, vectors) in seeds.items():
            wanted = max(1, min(most_cells, len(ids), -(-rows[n] // shard_rows)))
            tree = BallTree(ids, vectors, max(1, -(-len(ids) // wanted)))
            self.centres[n] = np.array([c for c, child in zip(tree.centres, tree.left) if not child][:most_cells])
        self.balls: dict[int, dict[int, tuple[float, int]]] = {}
        self.loose: set[int] = set()

    def of(self, n: int) -> np.ndarray:
        """Centres for vectors of a length; one at the origin if the sample has none."""
        return self.centres.get(n, np.zeros((1, n)))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centres = self.of(vectors.shape[1])
        cell = ((centres**2).sum(axis=1) - 2 * (vectors @ centres.T)).argmin(axis=1)
        return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(axis=1))

    def measured(self, found: list) -> None:
        """Take in (n, cell, radius, rows, top), a row a cell; top: the largest component's size."""
        tops: dict[int, float] = {}
        for n, cell, reach, rows, top in found:
            self.balls.setdefault(n, {})[cell] = (reach * (1 + 1e-9), rows)
            tops[n] = max(tops.get(n, 0.0), top)
        self.loose = {n for n, top in tops.items() if not top * top * n < 2.0**53}

    def subs(self, n: int, cell: int) -> int:
        return -(-self.balls[n][cell][1] // self.shard_rows)

    def floor(self, qid: int, query: np.ndarray, k: int) -> float:
        """The k-th score in the sample."""
        n = len(query)
        if n in self.loose or n not in self.seeds:
            return -float("inf")
        ids, vectors = self.seeds[n]
        s = (vectors @ query)[ids != qid]
        return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -float("inf")

    def ranked(self, query: np.ndarray) -> list[tuple[float, int]]:
        """(bound, cell) of the cells that hold vectors, highest bound first."""
        balls = self.balls.get(len(query), {})
        if not balls:
            return []
        own = sorted(balls)
        bounds = upper(self.of(len(query))[own], np.array([balls[c][0] for c in own]), query, float(np.sqrt(query @ query)), np.abs(query))
        if len(query) in self.loose:
            bounds[:] = float("inf")
        return sorted(zip(bounds.tolist(), own), key=lambda x: (-x[0], x[1]))


def _unpacked(batch: pa.RecordBatch, vector_at: int, size_at: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of each row."""
    flat, sizes = batch.column(vector_at).flatten().to_numpy(zero_copy_only=False), batch.column(size_at).to_numpy()
    ends = np.cumsum(sizes)
    for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
        yield i, flat[end - n : end]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_rows: int = 20_000, seed_rows: int = 2000, most_cells: int = 256, leaf: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products."""
    base = vectors.select(column(id_col).cast("long").alias("vec_id"), floored(column(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    base = materialise(base.where("v is not null and size(v) > 0 and vec_id is not null").withColumn("n", F.size("v")), "topk")
    rows = {r.n: r["count"] for r in base.groupBy("n").count().collect()}
    sample = base.select("vec_id", "v", "n").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(seed_rows).toArrow()
    seeds = {n: (own.column("vec_id").to_numpy(), np.array(own.column("v").to_pylist(), float)) for n in set(sample.column("n").to_pylist()) for own in [sample.filter(pc.equal(sample.column("n"), n))]}
    cells = Cells(seeds, rows, shard_rows, most_cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach, top = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            sizes, own = batch.column(2).to_numpy(), [v for _, v in _unpacked(batch, 1, 2)]
            for n in set(sizes.tolist()):
                at = np.flatnonzero(sizes == n)
                vs = np.array([own[i] for i in at])
                cell[at], reach[at] = cells.nearest(vs)
                top[at] = np.abs(vs).max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach), pa.array(top)], ["vec_id", "v", "n", "is_query", "cell", "reach", "top"])

    placed = map_arrow(base.select("vec_id", "v", "n", "is_query"), deal, "vec_id long, v array<double>, n int, is_query boolean, cell int, reach double, top double")
    placed = materialise(placed, "topk-cells")
    cells.measured([tuple(r) for r in placed.groupBy("n", "cell").agg(F.max("reach"), F.count("*"), F.max("top")).collect()])
    subs = F.expr(f"cast((rows + {shard_rows - 1}) div {shard_rows} as int)")
    sizes = F.broadcast(placed.groupBy("n", "cell").agg(F.count("*").alias("rows")))  # most_cells rows a vector length
    shards = placed.join(sizes, ["n", "cell"]).select("n", "cell", F.pmod(F.xxhash64("vec_id", "v"), subs).cast("int").alias("sub"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("low"))
    asked = placed.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.size("v"))
    asked = materialise(asked, "topk-queries")

    def routed(first: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, qids, known = [], batch.column(0).to_pylist(), batch.column(3).to_pylist()
                for i, q in _unpacked(batch, 1, 2):
                    low = max(cells.floor(qids[i], q, k), -float("inf") if known[i] is None or len(q) in cells.loose else float(known[i]))
                    ranked = cells.ranked(q)
                    for bound, cell in ranked[:1] if first else ranked[1:]:
                        if bound >= low:
                            out += [(len(q), cell, sub, 1, qids[i], q, low) for sub in range(cells.subs(len(q), cell))]
                columns = list(zip(*out)) or [()] * 7
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["n", "cell", "sub", "kind", "vec_id", "v", "low"])

        return route

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vs, tree = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            kinds, given, lows = (batch.column(i).to_pylist() for i in (3, 4, 6))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, v in _unpacked(batch, 5, 0):
                if keys[i] != key:
                    key, ids, vs, tree = keys[i], [], [], None
                if kinds[i] == 0:
                    ids.append(given[i])
                    vs.append(v)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree, vs = BallTree(np.array(ids, np.int64), np.array(vs), leaf), []
                if exact(tree.top, v):
                    own, scores = tree.search(given[i], v, lows[i], k)
                    scores = scores.astype(np.int64)
                else:
                    own, scores = (np.array(x, np.int64) for x in slow_search(tree.ids, tree.vectors, given[i], v, k))
                found.append((np.full(len(own), given[i]), own, scores))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["query_id", "vec_id", "score"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tasks = max(1, sum(cells.subs(n, c) for n, of in cells.balls.items() for c in of))

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        sent = map_arrow(queries.select("vec_id", "v", "n", "known"), routed(first), "n int, cell int, sub int, kind int, vec_id long, v array<double>, low double")
        sent = materialise(sent, "topk-sent")
        met = shards.join(F.broadcast(sent.select("n", "cell").distinct()), ["n", "cell"], "left_semi")
        dealt = met.unionByName(sent).repartition(tasks, "n", "cell", "sub").sortWithinPartitions("n", "cell", "sub", "kind", "vec_id")
        found = materialise(map_arrow(dealt, search, "query_id long, vec_id long, score long"), "topk-found")
        forget(sent)
        return found

    near = searched(asked.withColumn("known", F.lit(None).cast("long")), True)
    kth = near.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    far = searched(asked.join(kth, "vec_id", "left"), False)
    found = near.unionByName(far)
    forget(base, placed, asked)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), q AS (SELECT DISTINCT ON (vec_id) vec_id, v, n FROM e WHERE vec_id % 100 = 0 ORDER BY vec_id, v), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id AND q.n = c.n
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
