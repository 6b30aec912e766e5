"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints: 64 bits over word shingles; a bit is 1 if it is set in over half of the shingles' XXH64 hashes.

Covering masks: bit i of a fingerprint gets a nonzero vector phi(i) of radius + 1 bits, and table v (every nonzero v) keeps
the bits with odd parity of phi(i) & v. Any `radius` differing bits span at most `radius` dimensions, so some v is
orthogonal to all of them: in that table the two keys are equal. Every pair within the radius therefore meets in one of
the 2**(radius + 1) - 1 tables; the exact Hamming distance decides there.

Only distinct fingerprints with two or more in a bucket travel on. A bucket of n fingerprints is dealt by hash into
ceil(n / block) blocks, and each pair of blocks is a task's run: bounded memory whatever the bucket, no bucket is capped,
and a task returns a spanning forest of the links it found, never the pairs. Components come from alternating large-star
and small-star rounds over those forests, each round written to the shared folder.

Cases: null text has no words, like an empty one, and fingerprint zero; texts of fewer words than a shingle are one
shingle; a bit that exactly half of the hashes have is 0; very long texts are read whole, in memory that grows with
them; ids may be null (they link to none beyond their own fingerprint); rows may repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import LOWER, UPPER, forget, materialise, skewed_lookup, table
from rankloom.llm.textbatch import map_arrow

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
PIECE = 100_000  # shingles hashed at once


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned integer; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()  # splits at x20 and x09-x0D
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    vectors = (1 << (radius + 1)) - 1
    phi = [i % vectors + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a link, with the smallest node it reaches; roots themselves are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links_in_runs(starts: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs [starts[i], starts[i + 1]): short runs all at once by shifts, long runs in tiles."""
    size = np.diff(starts)
    of = np.repeat(np.arange(len(size)), size)
    short = size[of] <= 32
    at = np.flatnonzero(short)
    run, f, i = of[at], fps[at], ids[at]
    for shift in range(1, 32):
        same = run[shift:] == run[:-shift]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= radius)
        if near.any():
            yield i[shift:][near], i[:-shift][near]
    for k in np.flatnonzero(size > 32):
        f, i = fps[starts[k] : starts[k + 1]], ids[starts[k] : starts[k + 1]]
        for t in range(0, len(f), 256):
            x, y = np.nonzero(np.bitwise_count(f[t : t + 256, None] ^ f[None, t:]) <= radius)
            other = y > x
            yield i[t:][x[other]], i[t:][y[other]]


def similarity_forest(fps: DataFrame, total: int, radius: int = 3, block: int = 2048) -> DataFrame:
    """From (fp, rep), a row per distinct fingerprint, links (u, v) with v < u that connect all fingerprints within radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    spread = fps.where("rep is not null").select(
        "fp", "rep", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("x")
    ).select("fp", "rep", "x.t", "x.key")
    shared = materialise(spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    met = skewed_lookup(spread, shared, ["t", "key"], "n", total * len(signed))
    dealt = met.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "rep")
    runs = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, us, vs, held = None, [], [], 0

        def settle() -> None:
            nonlocal us, vs, held
            u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
            us, vs, held = [u], [v], 0

        def take(cols: list[np.ndarray], last: bool):
            nonlocal held
            change = np.zeros(len(cols[0]), bool)
            change[:1] = True
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            end = len(change) if last else starts[-1]  # the last run may go on in the next batch
            starts = np.append(starts if last else starts[:-1], end)
            for u, v in links_in_runs(starts, cols[4][:end].view(np.uint64), cols[5][:end], radius):
                us.append(u)
                vs.append(v)
                held += len(u)
                if held > 2_000_000:
                    settle()
            return [c[end:] for c in cols]

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            rest = take(cols, False) if len(cols[0]) else None
        if rest is not None and len(rest[0]):
            take(rest, True)
        settle()
        if len(us[0]):
            yield pa.RecordBatch.from_arrays([pa.array(us[0]), pa.array(vs[0])], ["u", "v"])

    return map_arrow(runs, link, "u long, v long").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """From links (u, v) with v < u, (node, component): the smallest node reachable; nodes without links are left out.

    Alternates large-star and small-star rounds until the links no longer change: they are then stars around the roots.
    Nodes with many links are looked up by broadcast (skewed_lookup), so the hub of a star meets no single task.
    """
    links = materialise(links, "cc")
    seen = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = skewed_lookup(both.where("v > u"), least, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = skewed_lookup(large, low, ["u"], "n", seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(links, large)
        links = new
        if now == seen:
            break
        seen = now
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.scratch = links.scratch
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, block: int = 2048) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable through links)."""
    marked = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "simhash-distinct")
    parts = connected_components(similarity_forest(fps.select("fp", "rep"), fps.count(), radius, block))
    named = fps.join(parts, fps.rep == parts.node, "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id"))
    named = materialise(named, "simhash-named")
    forget(fps, parts)
    return skewed_lookup(marked, named, ["fp"], "copies", marked.count()).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
