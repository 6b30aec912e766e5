"""A stored index of vectors: blocks of bounded size in cells with a centre, a radius and a norm, read in place by tasks.

build_index() writes it once: every vector goes to the nearest of at most `most_cells` centres, which Lloyd's rounds over a
bounded sample have found, and cells are dealt by hash into blocks of about `block` vectors, a folder each. Searching sends
only queries through a shuffle, to the cells that they need, and a task reads its block where it lies.

No vector of a cell is more similar to a query q than min(q . centre + |q| radius, |q| norm). A query asks the cell with the
highest bound first, and then those whose bound, rounded as similarities are, can still reach the k-th similarity
found there. A bound that only ties is asked too, since ties go by id, so the result is that of a search through all blocks.
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

from rankloom.operators.blocks import best_rows
from rankloom.operators.ranking import rank_by
from rankloom.sources.scratch import discard, write_once

PRODUCTS = 4_000_000
QUERIES, TILE = 256, 4096  # a product in single precision is of so many queries and rows: 4 MB
LONGEST = 1e150  # of vectors whose squares are finite
ANSWERED = 16_384  # queries that a task takes past a block, so that reading the block costs little beside it
TASKS = 4096  # at most so many for that, where there are fewer blocks
ROUTED = 1_000_000  # components, or visits, that are handed on at once: 8 MB


@dataclass
class VectorIndex:
    """What a search needs to know of an index: its place, and of each cell (at most `most_cells`) the centre, radius, norm and number of blocks."""

    root: str
    key_type: str
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    blocks: np.ndarray

    def bounds(self, queries: np.ndarray, decimals: int) -> np.ndarray:
        """The highest rounded similarity that each query could have in each cell, errors of rounding included."""
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        ball = queries @ self.centres.T + size * self.radii
        out = np.minimum(ball, size * self.norms) if len(self.radii) else ball
        return np.where(self.blocks > 0, out + 1e-9 * (np.abs(out) + size * (self.norms + 1)) + 0.5 * 10.0**-decimals, -np.inf)


def matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def _nearest_centre(centres: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (vectors @ centres.T)).argmin(axis=1)


def _centres(sample: np.ndarray, wanted: int, rounds: int = 5) -> np.ndarray:
    centres = sample[np.linspace(0, len(sample) - 1, wanted).astype(int)]
    for _ in range(rounds):
        own = _nearest_centre(centres, sample)
        n = np.bincount(own, minlength=wanted)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_index(rows: DataFrame, path: str, block: int = 65_536, most_cells: int = 1024, sample: int = 16_384) -> None:
    """Write the index of rows(id, v), v finite arrays of doubles of one length."""
    spark, n = rows.sparkSession, rows.count()
    wanted = max(1, min(most_cells, -(-n // block)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample if wanted > 1 else 1).select("v").toArrow()["v"].combine_chunks()
    centres = _centres(matrix(picked), min(wanted, len(picked))) if len(picked) else np.zeros((1, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vs = matrix(batch.column(1))
            cell = _nearest_centre(centres, vs)
            far, size = (np.sqrt((x**2).sum(axis=1)) for x in (vs - centres[cell], vs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(size)], ["id", "v", "cell", "far", "size"])

    key_type = rows.schema["id"].dataType.simpleString()
    placed = write_once(rows.select("id", "v").mapInArrow(deal, f"id {key_type}, v array<double>, cell int, far double, size double"), "vectors-placed")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.max("size").alias("size"), F.count("*").alias("n")).collect()}
    subs = {c: -(-r.n // block) for c, r in cells.items()}
    sub = F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*(F.lit(x) for kv in subs.items() for x in kv)), F.col("cell"))) if subs else F.lit(0)
    dealt = placed.select("id", "v", "cell", sub.cast("int").alias("sub")).repartition(max(1, sum(subs.values())), "cell", "sub")
    dealt.sortWithinPartitions("cell", "sub", "id").write.partitionBy("cell", "sub").parquet(f"{path}/blocks")
    facts = [(c, centres[c].tolist(), float(r.far), float(r.size), subs[c]) for c, r in sorted(cells.items())]
    spark.createDataFrame(facts, "cell int, centre array<double>, radius double, norm double, blocks int").coalesce(1).write.parquet(f"{path}/cells")
    discard(placed)


def open_index(spark: SparkSession, path: str, key_type: str) -> VectorIndex:
    """The index that build_index() wrote; `key_type` is the type of its ids."""
    own = sorted(spark.read.parquet(f"{path}/cells").collect())  # at most most_cells
    n = 1 + max((r.cell for r in own), default=0)
    centres, radii, norms, blocks = np.zeros((n, len(own[0].centre) if own else 1)), np.zeros(n), np.zeros(n), np.zeros(n, int)
    for r in own:
        centres[r.cell], radii[r.cell], norms[r.cell], blocks[r.cell] = r.centre, r.radius, r.norm, r.blocks
    return VectorIndex(path, key_type, centres, radii, norms, blocks)


def routed(index: VectorIndex, batches: Iterator[pa.RecordBatch], decimals: int, first: bool) -> Iterator[pa.RecordBatch]:
    """visits() within a task: batches of at most ROUTED components, and bounds of at most ROUTED visits at once, since a query's
    vector goes to each block that it asks."""
    for whole in batches:
        some = max(1, ROUTED // max(len(index.blocks), int(index.blocks.sum())))
        for batch in (whole.slice(at, some) for at in range(0, whole.num_rows, some)):
            if not index.blocks.any():
                continue
            vectors = matrix(batch.column(1))
            bounds = index.bounds(vectors, decimals)
            best = bounds.argmax(axis=1)
            asked = np.zeros(bounds.shape, bool)
            if first:
                asked[np.arange(len(best)), best] = index.blocks[best] > 0
            else:
                known = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                asked = (bounds >= np.where(np.isnan(known), -np.inf, known)[:, None]) & (index.blocks > 0)
                asked[np.arange(len(best)), best] = False
            row, cell = np.nonzero(asked)
            times = index.blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            sub = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            step = max(1, ROUTED // max(1, vectors.shape[1]))
            for at in range(0, len(row), step):
                own = pa.array(row[at : at + step])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + step], pa.int32()), pa.array(sub[at : at + step], pa.int32()), *(batch.column(i).take(own) for i in (0, 1, 2))], ["cell", "sub", "id", "v", "known"])


def visits(index: VectorIndex, queries: DataFrame, decimals: int, first: bool) -> DataFrame:
    """cell, sub, id, v, known: which blocks each query (known: its k-th similarity so far, or null) asks first, or after that."""
    kind = queries.schema["id"].dataType.simpleString()
    return queries.select("id", "v", "known").mapInArrow(lambda batches: routed(index, batches, decimals, first), f"cell int, sub int, id {kind}, v array<double>, known double")


def _answered(index: VectorIndex, asked: DataFrame, k: int, decimals: int, exclude_self: bool) -> DataFrame:
    """query, id, sim: each visit's k most similar rows, without those below its `known`."""
    root, kind = index.root, asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        files, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                own = int(keys[0][a]), int(keys[1][a])
                if own != at:
                    at, block, folder = own, None, f"{base}/blocks/cell={own[0]}/sub={own[1]}"
                    if files.get_file_info(folder).type == pyarrow.fs.FileType.Directory:  # a block that no row fell into has none
                        held = pq.read_table(folder, filesystem=files, partitioning=None, columns=["id", "v"])
                        held = held.take(pc.sort_indices(held["id"])).combine_chunks()
                        block = Block(held["id"].chunk(0), matrix(held["v"].chunk(0)))
                        del held
                if block is not None:
                    yield similar(block, *(batch.column(i).slice(a, b - a) for i in (2, 3, 4)), k, decimals, exclude_self)

    return asked.mapInArrow(run, f"query {kind}, id {index.key_type}, sim double")


class Block:
    """A block's rows in order of id: the ids, the vectors, and those once more in single precision, none longer than 1."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        with np.errstate(over="ignore"):
            self.scale = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0))) or 1.0
        self.light = (vectors / self.scale).astype(np.float32) if self.scale < LONGEST else None


def similar(block: Block, qids: pa.Array, given: pa.Array, known: pa.Array, k: int, decimals: int, exclude_self: bool) -> pa.RecordBatch:
    """The k rows of a block that are most similar to each query, without those clearly below the similarity that it has `known`."""
    own = pc.index_in(qids, value_set=block.ids).to_numpy(zero_copy_only=False).astype(float) if exclude_self else np.full(len(qids), np.nan)
    least, out = np.nan_to_num(known.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf), []
    for at in range(0, len(qids), QUERIES):
        here = slice(at, at + QUERIES)
        queries = matrix(given.slice(at, QUERIES))
        r, c, sims = _most_similar(block, queries, own[here], least[here], k, decimals)
        out.append((r + at, c, sims))
    r, c, sims = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([qids.take(pa.array(r)), block.ids.take(pa.array(c)), pa.array(sims)], ["query", "id", "sim"])


def _most_similar(block: Block, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity): products in single precision choose the rows that can be among the best, doubles decide.

    A query to which too many rows are as similar as the k-th is compared with all rows in doubles.
    """
    with np.errstate(all="ignore"):
        size = np.sqrt((queries**2).sum(axis=1))
        least = np.nan_to_num(least - 1e-9 * size * block.scale, nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # errors of rounding included, as in bounds()
    if block.light is None or k > TILE // 4 or len(block.ids) <= TILE or not (size < LONGEST).all():
        return _all_similar(block, queries, own, least, k, decimals)
    r, c, crowded = _candidates(block, queries, np.where(size > 0, size, 1.0), own, least, k, decimals)
    step = max(1, ROUTED // max(1, queries.shape[1]))
    sims = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", queries[r[i : i + step]], block.vectors[c[i : i + step]]) for i in range(0, len(r), step))])
    sims = np.round(sims, decimals) + 0.0
    order = np.lexsort((c, -sims, r))
    r, c, sims = r[order], c[order], sims[order]
    kept = (np.arange(len(r)) - np.searchsorted(r, r, "left") < k) & (sims >= least[r])
    found = [(r[kept], c[kept], sims[kept])]
    if crowded.any():
        whole = np.flatnonzero(crowded)
        r, c, sims = _all_similar(block, queries[whole], own[whole], least[whole], k, decimals)
        found.append((whole[r], c, sims))
    return tuple(np.concatenate(x) for x in zip(*found))


def _all_similar(block: Block, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_most_similar() by all products in doubles, PRODUCTS at a time."""
    step, out = max(1, PRODUCTS // len(block.ids)), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(queries), step):
        sims = queries[at : at + step] @ block.vectors.T
        np.round(sims, decimals, out=sims)
        sims += 0.0
        known = np.flatnonzero(~np.isnan(own[at : at + step]))
        sims[known, own[at : at + step][known].astype(np.int64)] = -np.inf
        r, c = best_rows(sims, k)
        kept = sims[r, c] >= least[at : at + step][r]
        out.append((r[kept] + at, c[kept], sims[r, c][kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _candidates(block: Block, queries: np.ndarray, size: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of all that can be among a query's k most similar rows; and the queries that have too many to be told here.

    The products are those of queries and rows at length 1 at most, so each is off by less than `error`, whatever the order
    of its sum (n + 2 roundings of 2^-24 each, taken twice and some over). What rounds to the k-th similarity or more is at
    most 10^-decimals below it.
    """
    n, light = len(queries), (queries / size[:, None]).astype(np.float32)
    error = (queries.shape[1] + 16) * 2.0**-23
    with np.errstate(all="ignore"):
        unit = 1.001 * 10.0**-decimals / (size * block.scale)
        floor = least / (size * block.scale) - unit - error
        floor = np.where(np.isnan(floor), -np.inf, floor).astype(np.float32)  # NaN: no bound in single precision
    crowded, most, told = np.zeros(n, bool), 4 * k + 256, 0
    rows, columns, values = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    space = np.empty(n * TILE, np.float32), np.empty(n * TILE, bool)
    for at in range(0, len(block.ids), TILE):
        width = min(TILE, len(block.ids) - at)
        products, reach = (x[: n * width].reshape(n, width) for x in space)
        np.matmul(light, block.light[at : at + width].T, out=products)
        selves = np.flatnonzero((own >= at) & (own < at + width))
        products[selves, own[selves].astype(np.int64) - at] = np.nan
        if at == 0 and width > k and np.isinf(floor).any():
            floor = np.maximum(floor, (-np.partition(-products, k - 1, axis=1)[:, k - 1] - unit - 2 * error).astype(np.float32))
        r, c = _true(np.greater_equal(products, floor[:, None], out=reach))
        held.append((r.astype(np.uint16), c + at, products[r, c]))
        told += len(r)
        if told > n * k // 2 or at + TILE >= len(block.ids):
            rows, columns, values = (np.concatenate(x) for x in zip((rows, columns, values), *held))
            held, told = [], 0
            count = np.bincount(rows, minlength=n)
            crowded |= count > most
            floor[crowded] = np.inf
            order = np.argsort(rows, kind="stable")
            order = order[~crowded[rows[order]]]
            rows, columns, values = rows[order], columns[order], values[order]
            count = np.bincount(rows, minlength=n)
            if count.max(initial=0) >= k:
                table = np.full((n, count.max()), np.inf, np.float32)
                table[rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)] = -values
                kth = -np.partition(table, k - 1, axis=1)[:, k - 1]
                floor = np.maximum(floor, (kth - unit - 2 * error).astype(np.float32))
                kept = values >= floor[rows]
                rows, columns, values = rows[kept], columns[kept], values[kept]
    return rows.astype(np.int64), columns, crowded


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero(mask) where few are true: words of 64 that hold none are passed over."""
    flat = mask.reshape(-1)
    if len(flat) % 64:
        flat = np.pad(flat, (0, -len(flat) % 64))
    words = np.flatnonzero(np.packbits(flat).view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 64)[words])
    return np.divmod(words[word] * 64 + bit, mask.shape[1])


def search(index: VectorIndex, queries: DataFrame, k: int, decimals: int = 6, exclude_self: bool = False) -> DataFrame:
    """query, id, sim, rank: the k most similar index rows of each query (id, v), similarity rounded, ties by id."""
    total, cores = max(1, int(index.blocks.sum())), queries.sparkSession.sparkContext.defaultParallelism
    wanted = -(-queries.count() // ANSWERED)
    slots = max(-(-2 * cores // total), min(wanted, TASKS // total))  # tasks a block, so that few blocks keep all cores busy

    def answered(given: DataFrame, first: bool) -> DataFrame:
        slot = F.pmod(F.xxhash64("id"), F.lit(slots))
        asked = visits(index, given, decimals, first).withColumn("slot", slot).repartition(total * slots, "cell", "sub", "slot")
        return _answered(index, asked.sortWithinPartitions("cell", "sub").select("cell", "sub", "id", "v", "known"), k, decimals, exclude_self)

    unknown = queries.select("id", "v", F.lit(None).cast("double").alias("known"))
    near = answered(unknown, True)
    if (index.blocks > 0).sum() > 1:  # with one cell the first visit is all
        near = write_once(near, "vectors-near")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "id"))
        kth = near.withColumn("at", place).where(F.col("at") == k).select(F.col("query").alias("id"), F.col("sim").alias("known"))
        near = near.unionByName(answered(queries.select("id", "v").join(kth, "id", "left").select("id", "v", "known"), False))
    return rank_by(near, ["query"], [F.desc("sim"), F.col("id")], limit=k)
