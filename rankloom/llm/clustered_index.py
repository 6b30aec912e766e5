"""Ranked lexical search over a clustered inverted index: documents are reordered by recursive graph bisection.

Bisection halves a set of documents and swaps documents between the halves while that lowers the cost of coding their
terms' gaps (a term that occurs d times among n documents costs about d log(n / (d + 1))), then goes on in each half. So
documents that share terms come to stand together.

1. The upper levels are fitted on a sample of at most `sample` documents, terms hashed to BUCKETS: 2^depth cells. Every
   document then goes down the same tree, to the half in which its terms cost less. Cells with more documents or postings
   than a shard should have are dealt into shards by the piece of the input that they stand in.
2. A task takes a shard, orders its documents by bisection down to clusters of `cluster` documents, and writes an inverted
   list a term (places in that order, counts), with the term's greatest weight in the shard. That is the index: a table that
   any number of queries may be asked of (build_index, search).
3. Queries take their terms' lists. A shard's bound for a query is the sum of its terms' greatest weights there. Each query
   visits the shard with the highest bound first, then those others whose bound reaches the 50th score (k) found there.
   Within a shard, clusters are visited by their bound in the same way, and the rest is left once no bound reaches the
   score. Bounds are exact integers, a bound that equals the score is still visited, and ties are settled by the documents' own
   ids, so the results are those of scoring every document.

Cases: null texts and those without terms take no part and don't count; terms are lower-cased in A-Z alone; ties go to the
smaller id, null ids come last; rows that repeat an id are documents of their own; a query's terms count once; queries that
are equal in id and text are answered once, queries with one id and different texts each from rank 1; a query without
terms, or with terms that no document has, has no rows; a very long text is read whole, in memory that grows with it;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.packing import packed, spread, unpacked
from rankloom.llm.shared import column, forget, materialise, table
from rankloom.llm.textbatch import groups_of, map_arrow
from rankloom.llm.words import TERM, cut

BUCKETS = 1 << 15
NO_ID = (1 << 63) - 1  # stands for a null id in ties


def _cost(d1: np.ndarray, d2: np.ndarray, n1: int, n2: int) -> np.ndarray:
    return d1 * np.log2(n1 / (d1 + 1)) + d2 * np.log2(n2 / (d2 + 1))


def bisected(term: np.ndarray, doc: np.ndarray, n: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n documents with postings (term, doc): which go to the second half; and how often each term is in either half.

    Terms are numbers without gaps. Each round moves as many documents as gain by it from one half to the other.
    """
    second = np.arange(n) >= n - n // 2
    n1, n2, terms = n - n // 2, n // 2, int(term.max()) + 1 if len(term) else 0
    d = np.bincount(term, minlength=terms).astype(float)
    for _ in range(rounds):
        d2 = np.bincount(term[second[doc]], minlength=terms).astype(float)
        d1 = d - d2
        now = _cost(d1, d2, n1, n2)
        over, back = now - _cost(np.maximum(d1 - 1, 0), d2 + 1, n1, n2), now - _cost(d1 + 1, np.maximum(d2 - 1, 0), n1, n2)
        gain = np.bincount(doc, np.where(second[doc], back[term], over[term]), n)
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        pairs = min(len(left), len(right))
        swap = gain[left[:pairs]] + gain[right[:pairs]] > 1e-9
        moved = int(np.argmin(swap)) if not swap.all() else pairs
        if not moved:
            break
        second[left[:moved]], second[right[:moved]] = True, False
    d2 = np.bincount(term[second[doc]], minlength=terms).astype(float)
    return second, d - d2, d2


def _halves(term: np.ndarray, doc: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of both halves: the documents, and their postings with documents and terms numbered anew."""
    for side in (False, True):
        own = np.flatnonzero(second == side)
        number = np.zeros(len(second), np.int64)
        number[own] = np.arange(len(own))
        mine = second[doc] == side
        there = np.zeros(int(term.max()) + 1 if len(term) else 0, np.int64)
        there[term[mine]] = 1
        yield own, (np.cumsum(there) - 1)[term[mine]], number[doc[mine]]


def ordered(term: np.ndarray, doc: np.ndarray, n: int, cluster: int) -> np.ndarray:
    """Documents 0 to n - 1 in the order of recursive bisection down to `cluster` of them."""
    out, todo = [], [(np.arange(n), term, doc)]
    while todo:
        docs, t, d = todo.pop()
        if len(docs) <= cluster:
            out.append(docs)
            continue
        second, *_ = bisected(t, d, len(docs))
        (own1, t1, d1), (own2, t2, d2) = _halves(t, d, second)
        todo += [(docs[own2], t2, d2), (docs[own1], t1, d1)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fitted(docs: list[np.ndarray], depth: int) -> np.ndarray:
    """A row a node of the upper tree: by how much each bucket makes a document cheaper in the first half than in the second."""
    out = np.zeros(((1 << depth) - 1, BUCKETS), np.float32)
    nodes = {0: docs}
    for node in range(len(out)):
        own = nodes.pop(node)
        if len(own) < 2:
            nodes |= {2 * node + 1: own, 2 * node + 2: []}
            continue
        used, term = np.unique(np.concatenate(own), return_inverse=True)
        doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
        second, d1, d2 = bisected(term, doc, len(own), 20)
        n1, n2 = int((~second).sum()), int(second.sum())
        every = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        every[0][used], every[1][used] = d1, d2
        out[node] = _cost(every[0], every[1] + 1, n1, n2) - _cost(every[0] + 1, every[1], n1, n2)
        nodes |= {2 * node + 1: [x for x, s in zip(own, second) if not s], 2 * node + 2: [x for x, s in zip(own, second) if s]}
    return out


class Postings:
    """The terms of a group of texts: for each document its number of terms, for each of its different terms a posting."""

    def __init__(self, texts: pa.Array):
        words, bounds = cut(texts, TERM, lower=True)
        coded = words.dictionary_encode()
        self.words, self.n = coded.dictionary, np.diff(bounds)
        key, self.tf = np.unique(np.repeat(np.arange(len(texts)), self.n) * max(1, len(self.words)) + coded.indices.to_numpy(), return_counts=True)
        self.doc, self.term = key // max(1, len(self.words)), key % max(1, len(self.words))
        self.bucket = np.fromiter((xxhash.xxh64_intdigest(w) % BUCKETS for w in self.words.to_pylist()), np.int64, len(self.words))

    def cells(self, tree: np.ndarray) -> np.ndarray:
        node = np.zeros(len(self.n), np.int64)
        for _ in range(len(tree).bit_length()):
            cheaper = np.bincount(self.doc, tree[node[self.doc], self.bucket[self.term]], len(self.n))
            node = 2 * node + 1 + (cheaper < 0)
        return node - len(tree)


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups_of(batch, 0):
                p = Postings(own.column(0))
                sets = [np.unique(p.bucket[t]) for t in np.split(p.term, np.searchsorted(p.doc, np.arange(1, own.num_rows)))] if own.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array([s.tolist() for s in sets if len(s)], pa.list_(pa.int32()))], ["buckets"])

    return map_arrow(docs.select("text"), run, "buckets array<int>")


def _pieces(docs: DataFrame, tree: np.ndarray) -> DataFrame:
    """Documents by cell, as they stand in the input: a row for each cell in each group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for own in groups_of(batch, 1, 2_000_000):
                p = Postings(own.column(1))
                cell = np.where(p.n > 0, p.cells(tree), -1)
                ids = own.column(0)
                rows: list[tuple] = []
                of_posting = cell[p.doc]
                for c in np.unique(cell[cell >= 0]).tolist():
                    docs_here, mine = np.flatnonzero(cell == c), of_posting == c
                    used, term = np.unique(p.term[mine], return_inverse=True)
                    known = ids.take(pa.array(docs_here))
                    id_bits = pc.fill_null(known, 0).to_numpy().astype(np.int64)
                    size = np.bincount(np.searchsorted(docs_here, p.doc[mine]), minlength=len(docs_here))
                    numbers = packed(id_bits & 0xFFFFFFFF, (id_bits >> 32) & 0xFFFFFFFF, known.is_null().to_numpy(zero_copy_only=False).astype(np.int64), p.n[docs_here], size, term, p.tf[mine])
                    words = b"\n".join(p.words.take(pa.array(used)).to_pylist())
                    rows.append((c, piece, len(docs_here), int(p.n[docs_here].sum()), len(term), numbers, len(words), pa.compress(words, codec="zstd", asbytes=True)))
                piece += 1
                if rows:
                    kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.binary())
                    names = ["cell", "piece", "docs", "words", "postings", "numbers", "size", "terms"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return map_arrow(docs, run, "cell int, piece long, docs long, words long, postings long, numbers binary, size long, terms binary")


def ratio(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _shard(pieces: list[tuple], docs: int, words: int, cluster: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and whether they are null and m by place; terms, their document numbers and greatest weights; places and counts by term."""
    ids, nulls, ns, sizes, terms, tfs, spelled = [], [], [], [], [], [], []
    for numbers, size, data in pieces:
        low, high, null, n, own_size, term, tf = unpacked(numbers)
        ids.append(low | (high << 32))
        nulls.append(null > 0)
        ns.append(n)
        sizes.append(own_size)
        terms.append(term + sum(map(len, spelled)))
        tfs.append(tf)
        spelled.append(pa.decompress(data, size, codec="zstd", asbytes=True).split(b"\n"))
    coded = pa.array([w for own in spelled for w in own], pa.binary()).dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)[np.concatenate(terms)]
    n, size, tf = np.concatenate(ns), np.concatenate(sizes), np.concatenate(tfs)
    doc = np.repeat(np.arange(len(n)), size)
    df = np.bincount(term, minlength=len(coded.dictionary))
    shared = df[term] > 1  # a term of one document alone costs the same everywhere
    number = np.cumsum(df > 1) - 1
    order = ordered(number[term[shared]], doc[shared], len(n), cluster)
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    by_term = np.lexsort((place[doc], term))
    term, place_of, tf = term[by_term], place[doc][by_term], tf[by_term]
    m = 50 + (50 * n[order] * docs) // words
    top = np.maximum.reduceat(ratio(tf, m[place_of]), np.cumsum(df) - df)
    return np.concatenate(ids)[order], np.concatenate(nulls)[order], m, coded.dictionary.to_pylist(), df, top, place_of, tf


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary of unsigned 32-bit numbers for each of the sizes, without copying."""
    offsets = np.cumsum([0, *(4 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<u4"))])


INDEX = "cell int, sub int, term binary, df long, top long, places binary, counts binary, id_null binary"


def _index(pieces: DataFrame, docs: int, words: int, cluster: int) -> DataFrame:
    """A row a shard and term; and one a shard, its term null, with the documents: m and the two halves of their ids by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def done() -> Iterator[pa.RecordBatch]:
            ids, null, m, terms, df, top, places, tf = _shard(own, docs, words, cluster)
            whole = np.array([len(ids)])
            halves = pa.array([ids.astype("<i8").tobytes()], pa.binary())
            none = pa.nulls(1, pa.binary())
            yield _shard_rows(key, none, pa.array(whole), pa.array([0]), halves, _binaries(m, whole), pa.array([np.packbits(null).tobytes()], pa.binary()))
            upto = np.cumsum(df)
            for lo in range(0, len(terms), 20_000):
                hi = min(lo + 20_000, len(terms))
                a, b = upto[lo] - df[lo], upto[hi - 1]
                yield _shard_rows(key, pa.array(terms[lo:hi], pa.binary()), pa.array(df[lo:hi]), pa.array(top[lo:hi]), _binaries(places[a:b], df[lo:hi]), _binaries(tf[a:b], df[lo:hi]), pa.nulls(hi - lo, pa.binary()))

        for batch in batches:
            for cell, sub, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, sub) != key and own:
                    yield from done()
                    own = []
                key = cell, sub
                own.append(tuple(piece))
        if own:
            yield from done()

    return map_arrow(pieces.select("cell", "sub", "numbers", "size", "terms"), run, INDEX)


def _shard_rows(key: tuple[int, int], terms: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
    own = [pa.array(np.full(len(terms), k, np.int32)) for k in key]
    return pa.RecordBatch.from_arrays([*own, terms, *columns], [f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4096, most_cells: int = 64, shard_docs: int = 4096, shard_postings: int = 2_000_000, cluster: int = 128) -> tuple[DataFrame, int]:
    """The index of all documents with terms, written to the shared folder, and how many they are."""
    given = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    total = given.count()
    picked = given.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // (2 * sample)))) == 0).limit(sample)
    depth = min(most_cells, max(1, total // shard_docs)).bit_length() - 1
    tree = fitted([np.array(r.buckets) for r in _features(picked).toLocalIterator()] if depth else [], depth)
    pieces = materialise(_pieces(given, tree), "index-pieces")
    cells = pieces.groupBy("cell").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.sum("postings").alias("postings")).collect()
    n, words = sum(r.docs for r in cells), sum(r.words for r in cells)
    subs = {r.cell: max(-(-r.docs // shard_docs), -(-r.postings // shard_postings)) for r in cells}
    sub = F.pmod(F.xxhash64("piece"), F.element_at(F.create_map(*(F.lit(x) for kv in subs.items() for x in kv)), F.col("cell"))) if subs else F.lit(0)
    dealt = pieces.withColumn("sub", sub.cast("int")).repartition(max(1, sum(subs.values())), "cell", "sub").sortWithinPartitions("cell", "sub", "piece")
    index = materialise(_index(dealt, n, words, cluster), "index")
    forget(pieces)
    return index, n


class Lists:
    """What a shard's task holds for its queries: documents by place, and the queried terms' lists."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, m: np.ndarray, cluster: int):
        self.ids, self.null, self.m, self.cluster = ids, null, m, cluster
        self.tie = np.where(null, NO_ID, ids)
        self.clusters = -(-len(ids) // cluster)
        self.of: dict[bytes, tuple] = {}
        self.visited = 0

    def add(self, term: bytes, places: np.ndarray, tf: np.ndarray) -> None:
        weight = ratio(tf, self.m[places])
        own, first = np.unique(places // self.cluster, return_index=True)
        self.of[term] = places, weight, own, first, np.diff(np.append(first, len(places))), np.maximum.reduceat(weight, first)

    def best(self, terms: list[bytes], weights: list[int], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the query's best k here whose scores reach `floor`, visiting clusters by their bound."""
        known = [(self.of[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.of]
        bound = np.zeros(self.clusters, np.int64)
        for (_, _, own, _, _, top), w in known:
            bound[own] += w * top
        turn = np.argsort(-bound, kind="stable")
        turn = turn[bound[turn] >= max(1, floor)]
        places, scores, kth, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, floor), 0, 4
        while at < len(turn) and bound[turn[at]] >= kth:
            visit = np.zeros(self.clusters, bool)
            visit[turn[at : at + step]] = True
            self.visited += len(turn[at : at + step])
            total = np.zeros(len(self.ids), np.int64)
            for (where, weight, own, first, size, _), w in known:
                hit = visit[own]
                entry = spread(first[hit], size[hit])
                total[where[entry]] += w * weight[entry]
            here = np.flatnonzero(total >= kth)
            places, scores = np.concatenate([places, here]), np.concatenate([scores, total[here]])
            top = np.lexsort((self.tie[places], -scores))[:k]
            places, scores = places[top], scores[top]
            if len(scores) == k:
                kth = max(kth, int(scores[-1]))
            at += step
            step *= 2
        return places, scores


def _visited(lists: DataFrame, visits: DataFrame, shards: int, k: int, cluster: int) -> DataFrame:
    """q, id, score: what each visit finds."""
    nothing = lambda t: F.lit(None).cast(t)
    met = lists.join(visits.select("cell", "sub").distinct(), ["cell", "sub"], "left_semi")
    a = met.select("cell", "sub", F.when(F.col("term").isNull(), 0).otherwise(1).alias("kind"), "term", "places", "counts", "id_null", nothing("long").alias("q"), nothing("array<binary>").alias("terms"), nothing("array<long>").alias("ws"), nothing("long").alias("low"))
    b = visits.select("cell", "sub", F.lit(2).alias("kind"), *(nothing("binary").alias(c) for c in ("term", "places", "counts", "id_null")), "q", "terms", "ws", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out: list[tuple] = []
            for kind, term, places, counts, null, q, terms, ws, low in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if kind == 0:
                    ids = np.frombuffer(places, "<i8")
                    shard = Lists(ids, np.unpackbits(np.frombuffer(null, np.uint8))[: len(ids)] > 0, np.frombuffer(counts, "<u4").astype(np.int64), cluster)
                elif kind == 1:
                    shard.add(term, np.frombuffer(places, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64))
                else:
                    at, scores = shard.best(terms, ws, low or 0, k)
                    out += [(q, None if n else i, s) for i, n, s in zip(shard.ids[at].tolist(), shard.null[at].tolist(), scores.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["q", "id", "score"])

    dealt = a.unionByName(b).repartition(shards, "cell", "sub").sortWithinPartitions("cell", "sub", "kind", "q")
    return map_arrow(dealt, run, "q long, id long, score long")


def terms_of(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """q, item_id, term: the different terms of each different query."""
    given = queries.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups_of(batch, 1):
                p = Postings(own.column(1))
                yield pa.RecordBatch.from_arrays([own.column(2).take(pa.array(p.doc)), own.column(0).take(pa.array(p.doc)), p.words.cast(pa.binary()).take(pa.array(p.term))], ["q", "item_id", "term"])

    keyed = given.select("id", "text", F.xxhash64(F.col("id").cast("string"), "text").alias("q"))
    return map_arrow(keyed, run, f"q long, item_id {given.schema['id'].dataType.simpleString()}, term binary").distinct()


def search(index: DataFrame, docs: int, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50, cluster: int = 128) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best of the index's `docs` documents."""
    asked = materialise(terms_of(queries, id_col, text_col), "search-terms")
    wanted = asked.select("term").distinct()
    lists = materialise(index.join(wanted, "term", "left_semi").select(index.columns).unionByName(index.where("term is null")), "search-lists")
    df = lists.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = materialise(asked.join(df, "term").select("q", "item_id", "term", weight.alias("w")), "search-weights")
    packs = weighed.groupBy("q").agg(F.first("item_id").alias("item_id"), F.collect_list(F.struct("term", "w")).alias("p"))
    packs = packs.select("q", "item_id", F.col("p.term").alias("terms"), F.col("p.w").alias("ws"))
    bounds = weighed.select("q", "term", "w").join(lists.where("term is not null").select("term", "cell", "sub", "top"), "term")
    bounds = materialise(bounds.groupBy("q", "cell", "sub").agg(F.sum(F.col("w") * F.col("top")).alias("bound")), "search-bounds")
    shards = max(1, index.where("term is null").count())
    best = W.partitionBy("q").orderBy(F.desc("bound"), "cell", "sub")
    turns = bounds.withColumn("turn", F.row_number().over(best))
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    first = turns.where("turn = 1").join(packs, "q").withColumn("low", F.lit(0).cast("long"))
    near = materialise(_visited(lists, first, shards, k, cluster), "search-near")
    kth = near.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("q", F.col("score").alias("low"))
    rest = turns.where("turn > 1").join(kth, "q", "left").withColumn("low", F.coalesce("low", F.lit(0).cast("long"))).where("bound >= low and bound > 0").join(packs, "q")
    far = materialise(_visited(lists, rest, shards, k, cluster), "search-far")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(packs.select("q", "item_id"), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = build_index(table(spark, sf_dir, "documents"))
    return search(index, docs, table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), sized AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN df USING (term), total
), s AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN sized USING (r), total GROUP BY item_id, r
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
