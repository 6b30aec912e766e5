"""The near-copy stage: SimHash covering tables and shingle bands propose, exact Jaccard similarity decides.

Texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more are linked; of each component of
links one row stays. A SimHash of 64 bits puts most pairs of similarity 0.8 about ten bits apart, where covering tables
would need a radius that keeps no bits to tell texts apart. They find pairs within three bits for certain; the rest is
proposed by bands of minimal shingle hashes.

1. One pass over the texts gives each its set of distinct shingles, of which stay a digest of the set (equal sets are one
   node from here on), its size, its fingerprint, `BANDS` band keys of `ROWS` minimal hashes each, and a bitmap.
2. Links of the covering tables are taken as possible. Sets that share a band key are compared by size and bitmap. Both are
   bounds that no pair with the similarity exceeds: sets of sizes a and b with Jaccard s differ in (1 - s) / (1 + s) (a + b)
   shingles, so in no more bits than that.
3. The components of what is left are only possible ones. One text for each of their sets is read again, and within each
   component the exact Jaccard similarity links pairs; pairs that are connected already are not compared.

A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 2e-12 at 0.9. Nothing else is
lost: no bucket or component is capped. Both are dealt into blocks, and each pair of blocks is a task's run.

Cases: null text is an empty one; all texts without words have the same, empty set; fewer words than a shingle are one
shingle; the smallest id of a component stays, null ids last; rows are told apart by id and text, and of rows that repeat
both the least by a hash of their other columns stays; a very long text is read whole, its shingles are 64-bit hashes in
memory that grows with it; an empty table gives an empty result; other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import KeyFilter, columns, forget, materialise, skewed_lookup
from rankloom.llm.simhash import FOLD, connected_components, forest, majority, similarity_forest
from rankloom.llm.textbatch import groups_of, map_arrow

BANDS, ROWS, BITS = 32, 5, 1024
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 31, (2, BANDS * ROWS), np.uint32) * np.uint32(2) + np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, put together from hashes of their words."""
    words, digest = (text or "").encode("utf-8", "replace").translate(FOLD).split(), xxhash.xxh64_intdigest
    own = np.fromiter(map(digest, words, repeat(seed)), np.uint64, len(words))
    wide = min(width, len(words))
    n = len(words) - wide + 1 if words else 0
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = out * MIX + own[i : i + n]
    return np.unique(mixed(out))


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; sets without shingles have none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    low, short = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, (short[at : at + 512, None] * FACTORS + SHIFTS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(BANDS, ROWS))], np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def possible(sizes: np.ndarray, bits: np.ndarray, size: int, own: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets can have the similarity to the one of `size` with the bitmap `own`."""
    near = np.minimum(sizes, size) >= similarity * np.maximum(sizes, size) - 1e-9
    at = np.flatnonzero(near)
    apart = np.bitwise_count(bits[at] ^ own).sum(axis=1, dtype=np.int64)
    near[at] = apart <= (1 - similarity) / (1 + similarity) * (sizes[at] + size) + 1e-6
    return near


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def run_links(nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the nodes of one run as all their pairs would. Without sets the bounds decide."""
    label, us, vs = np.arange(len(nodes)), [], []
    for i in range(1, len(nodes)):
        left = np.flatnonzero(possible(sizes[:i], bits[:i], sizes[i], bits[i], similarity))
        while len(left):
            j, left = left[0], left[1:]
            if nodes[i] != nodes[j] and (sets is None or similar(sets[i], sets[j], similarity)):
                us.append(max(nodes[i], nodes[j]))
                vs.append(min(nodes[i], nodes[j]))
                old, new = label[i], label[j]
                label[label == old] = new
                left = left[label[left] != new]
    return np.array(us, np.int64), np.array(vs, np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, key (of id and text), fp (digest of the set), n (its size), sim (its fingerprint), keys, bits."""
    base = docs.select(F.col("doc_id").alias("id"), row_key().alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, 2):
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                columns = [
                    pa.array([*map(set_digest, sets)], pa.int64()), pa.array([*map(len, sets)], pa.int64()),
                    pa.array(np.array([*map(majority, sets)], np.uint64).view(np.int64)), pa.array([*map(band_keys, sets)], pa.list_(pa.int64())),
                    pa.array([*map(bitmap, sets)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "key", "fp", "n", "sim", "keys", "bits"])

    return map_arrow(base, run, T.StructType([base.schema["id"], *T.StructType.fromDDL("key long, fp long, n long, sim long, keys array<long>, bits binary")]))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def dealt(rows: DataFrame, blocks) -> DataFrame:
    """rows(group, fp, ...) once for each run (group, a, b) of block pairs they are in."""
    out = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = out.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    return out.drop("blocks", "own", "other")


def links_of(runs: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """Links (u, v) with v < u within the runs of (group, a, b, fp, n, bits[, shingles])."""
    runs = runs.select("group", "a", "b", "fp", "n", "bits", *(["shingles"] if exact else []))
    runs = runs.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, at, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], None, []

        def settle() -> None:
            nodes, sizes = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            bits = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1)
            u, v = run_links(nodes, sizes, bits, [np.frombuffer(h[3], np.uint64) for h in held] if exact else None, similarity)
            us.append(u)
            vs.append(v)
            if len(us) > 1000:
                us[:], vs[:] = ([x] for x in forest(np.concatenate(us), np.concatenate(vs)))

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, *row in zip(keys, *(batch.column(i).to_pylist() for i in range(3, batch.num_columns))):
                if key != at and held:
                    settle()
                    held = []
                at = key
                held.append(row)
        if held:
            settle()
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(runs, link, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """fp and shingles of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, 0):
                sets = [shingle_set(t.as_py(), width) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([*map(set_digest, sets)], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    return map_arrow(docs.select("text"), run, "fp long, shingles binary")


def in_buckets(spread: DataFrame, shared: DataFrame, total: int, parts: int = 1000) -> DataFrame:
    """The rows of spread(fp, group) whose group is in the materialised shared(group, rows), with its rows.

    As skewed_lookup(), but the groups with a thousandth of all rows, at most `parts` numbers, are told apart by a filter:
    most rows share their band key with no other, and none of them goes through a join just to be kept from a hot group.
    """
    is_hot = F.col("rows") * parts >= F.lit(total)
    hot = F.col("group").isin([r["group"] for r in shared.where(is_hot).select("group").collect()])
    return spread.where(hot).join(F.broadcast(shared.where(is_hot)), "group").unionByName(spread.where(~hot).join(shared.where(~is_hot), "group"))


def proposed(nodes: DataFrame, similarity: float, radius: int, block: int) -> DataFrame:
    """Links (u, v) between digests that may have the similarity: within `radius` bits, or sharing a band."""
    sims = materialise(nodes.groupBy("sim").agg(F.min("fp").alias("rep"), F.count("*").alias("nodes")), "near-sims")
    covering = similarity_forest(sims.select(F.col("sim").alias("fp"), "rep"), sims.count(), radius)
    same = skewed_lookup(nodes.select("fp", "sim"), sims, ["sim"], "nodes", nodes.count()).where("fp <> rep").select(F.col("fp").alias("u"), F.col("rep").alias("v"))

    spread = nodes.select("fp", F.explode("keys").alias("group"))
    shared = materialise(spread.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1"), "near-buckets")
    met = materialise(in_buckets(spread, shared, nodes.count() * BANDS), "near-met")
    runs = dealt(met, F.ceil(F.col("rows") / block)).drop("rows")
    bands = links_of(runs.join(nodes.select("fp", "n", "bits"), "fp"), similarity, False)
    return materialise(covering.unionByName(same).unionByName(bands).distinct(), "near-links")


def near_components(docs: DataFrame, marked: DataFrame, width: int, similarity: float, radius: int, block: int, weight: int) -> DataFrame:
    """node, component: digests of sets that have a near copy, with the smallest one they reach."""
    nodes = marked.groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.min("key").alias("key"))
    nodes = materialise(nodes, "near-nodes")
    maybe = connected_components(proposed(nodes, similarity, radius, block))
    members = maybe.unionByName(maybe.select(F.col("component").alias("node"), "component").distinct())
    members = materialise(members.select(F.col("node").alias("fp"), F.col("component").alias("group")).join(nodes.select("fp", "n", "bits", "key"), "fp"), "near-members")
    again = KeyFilter(members, "key").marked(docs.select("text", row_key().alias("key")), F.col("key"), "hit").where("hit")
    again = again.groupBy("key").agg(F.first("text").alias("text"))  # equal rows are one before they are shuffled
    sets = shingle_sets(again.join(members.select("key"), "key", "left_semi"), width).dropDuplicates(["fp"])
    sets = materialise(members.drop("key").join(sets, "fp"), "near-sets")
    load = sets.groupBy("group").agg(F.sum("n").alias("load"), F.count("*").alias("rows"))
    runs = dealt(skewed_lookup(sets, load, ["group"], "rows", sets.count()), F.ceil(F.greatest(F.col("load") / weight, F.col("rows") / block)))
    out = connected_components(links_of(runs, similarity, True))
    forget(nodes, maybe, members, sets)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3, block: int = 4096, weight: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component of near copies: the one with the smallest id."""
    marked = materialise(sketches(docs, width), "near")
    parts = near_components(docs, marked, width, similarity, radius, block, weight)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    fps = marked.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    fps = materialise(fps.join(parts, fps.fp == parts.node, "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("group")), "near-parts")
    groups = fps.groupBy("group").agg(F.min("first").alias("kept"), F.sum("copies").alias("rows"), F.count("*").alias("nodes")).where("rows > 1")
    named = skewed_lookup(fps.select("fp", "group", "copies"), groups, ["group"], "nodes", fps.count()).select("fp", "kept", "copies")
    rows = skewed_lookup(marked.select("id", "key", "fp"), named, ["fp"], "copies", marked.count())
    stays = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("key") == F.col("kept.key"))
    found = materialise(rows.groupBy("id", "key").agg(F.max(stays).alias("stays"), F.count("*").alias("times")), "near-found")
    total = marked.count()
    forget(parts, fps, marked)

    same_id = F.to_json(F.struct("id")).alias("same_id")  # no null, so that it can be joined on
    packed = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("id"), row_key().alias("key"))
    packed = KeyFilter(found, "key").marked(packed, F.col("key"), "hit")
    met = skewed_lookup(packed.where("hit").withColumn("same_id", same_id), found.select(same_id, "key", "stays", "times"), ["key", "same_id"], "times", total, "left")
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    look = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    once = met.where("stays and times > 1").groupBy("same_id", "key").agg(F.min_by("row", look).alias("row"))
    kept = met.where("stays is null or (stays and times = 1)")
    return packed.where("not hit").select("row.*").unionByName(kept.select("row.*")).unionByName(once.select("row.*"))
