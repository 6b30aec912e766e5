"""Passages that occur more than once: windows of words that repeat, found by doubling their length level by level.

A window of `length` words repeats only if each shorter window inside does. So short windows come first, and only what
repeats at one length is looked at with twice that length, until `length` is reached or nothing is left:

1. Levels are `length`, its half, that one's half and so on down to `shortest`, from short to long.
2. At a level, each window of `length` words that is still a candidate is stood for by the shorter window inside it that has
   the least hash, the leftmost if several do. Equal windows choose equal ones at equal places, so nothing is lost, and
   neighbours mostly choose the same: the first level sends about 2 hashes for `length` - `shortest` words to be counted.
3. Hashes are counted over all documents. Candidates whose hash occurs once are out, and texts without candidates are not
   read again. Texts that remain are written once, equal ones as one with its number of copies; later levels read them
   where they lie, and only candidates' places and hashes are shuffled. All windows of a text with copies repeat.
4. At the last level the windows themselves are counted, by 128 bits. Every word that a repeated one covers goes.

Hashes of windows are built by doubling too, from two hashes of each word. A hash that very many documents share meets no single task: its count is summed before the shuffle and looked up by broadcast.

Cases: null and empty texts have no words; a text shorter than `length` keeps all; windows are judged on what is read, not
on what is left; windows within one document count, also if they overlap; equal rows are copies of each other, and so
are rows with null ids; a very long text is read whole, in memory that grows with it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import KeyFilter, column, forget, materialise, skewed_lookup, table
from rankloom.llm.textbatch import groups_of, map_arrow
from rankloom.llm.words import INKED, cut, hashed

KEY = ["k1", "k2"]
GROUP = 2_000_000  # bytes of text worked on at a time
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def levels(length: int, shortest: int) -> list[int]:
    """Lengths from short to long, each at most twice the one before, the last `length`."""
    out = [length]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def joined(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """The hash of two windows in their order."""
    with np.errstate(over="ignore"):
        x = a * MIX[lane] + ((b << np.uint64(31)) | (b >> np.uint64(33))) * MIX[lane + 2]
        x = (x ^ (x >> np.uint64(29))) * MIX[(lane + 1) % 4]
        return x ^ (x >> np.uint64(32))


def windows(words: np.ndarray, length: int, lane: int) -> np.ndarray:
    """The hash of `length` words from each place on where so many follow, built by doubling."""
    out, n = words, 1
    while n < length:
        to = min(2 * n, length)
        out = joined(out[: len(out) - (to - n)], out[to - n :], lane)
        n = to
    return out


def least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of `width` hashes from each place on, the leftmost if several are."""
    best, n = np.arange(len(hashes)), 1
    while n < width:
        to = min(2 * n, width)
        left, right = best[: len(best) - (to - n)], best[to - n :]
        best = np.where(hashes[left] <= hashes[right], left, right)
        n = to
    return best


class Level:
    """The windows of one level in a group of texts: which candidates there are, and the hash that stands for each."""

    def __init__(self, texts: pa.Array, length: int, at: int):
        self.words, self.bounds = cut(texts, INKED)
        both = hashed(self.words)
        n = len(self.words)
        self.length, self.lanes = length, [windows(h, at, lane) if n >= length else h[:0] for lane, h in enumerate(both)]
        doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        last = np.repeat(self.bounds[1:], np.diff(self.bounds)) - length
        self.starts = np.flatnonzero(np.arange(n) <= last)
        self.stands = least(self.lanes[0], length - at + 1)[self.starts] if len(self.starts) else self.starts
        self.doc = doc

    def kept(self, at: int, known: np.ndarray) -> None:
        """Keep the candidates for which a place stands, at an earlier level, that is among those known."""
        if len(self.starts):
            first = windows(hashed(self.words)[0], at, 0)
            own = np.isin(least(first, self.length - at + 1)[self.starts], known)
            self.starts, self.stands = self.starts[own], self.stands[own]

    def sent(self) -> list[list[np.ndarray]]:
        """For each text the places that stand for its candidates, from its start, and their two hashes."""
        places = np.unique(self.stands)
        upto = np.searchsorted(self.doc[places] if len(places) else places, np.arange(len(self.bounds)))
        return [[places[a:b] - at, *(h[places[a:b]].view(np.int64) for h in self.lanes)] for a, b, at in zip(upto, upto[1:], self.bounds)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first(docs: DataFrame, length: int, at: int) -> DataFrame:
    """A row a document: its id and key, number of words, digest of all words, and the first level's places and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups_of(batch, 1, GROUP):
                level = Level(own.column(1), length, at)
                digests = [_digest(t.encode().split()) if t else _digest([]) for t in own.column(1).to_pylist()]
                ps, hs, _ = zip(*level.sent())
                columns = [own.column(0), own.column(2), own.column(3), pa.array(np.diff(level.bounds)), pa.array(digests), _lists(ps, pa.int32()), _lists(hs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", *KEY, "n_words", "digest", "ps", "hs"])

    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n_words long, digest string, ps array<int>, hs array<long>")


def _in_place(asked: DataFrame, texts: DataFrame, run: Callable[[pa.Array, pa.Array, list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """run(numbers, texts, what is asked of each) for the asked rows (t, copies, ps) in groups, their texts read from the
    files of `texts` (t, text) where they lie: only what is asked goes through a shuffle."""
    files = texts.select("t", F.col("_metadata.file_path").alias("file"))
    dealt = asked.join(files, "t").select("file", "t", "copies", "ps")
    dealt = dealt.repartition(max(1, len(texts.inputFiles())), "file").sortWithinPartitions("file", "t")

    def read(file: str, wanted: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        system, path = pyarrow.fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(256, columns=["t", "text"]):
                own = batch.filter(pc.is_in(batch.column(0), value_set=pa.array(wanted, pa.int64())))
                for group in groups_of(own, 1, GROUP):
                    yield run(group.column(0), group.column(1), [wanted[t] for t in group.column(0).to_pylist()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted = None, {}
        for batch in batches:
            sizes, flat = batch.column(3).value_lengths().to_numpy(), batch.column(3).flatten().to_numpy()
            for file, t, copies, end, n in zip(*(batch.column(i).to_pylist() for i in range(3)), np.cumsum(sizes).tolist(), sizes.tolist()):
                if file != at:
                    if wanted:
                        yield from read(at, wanted)
                    at, wanted = file, {}
                wanted[t] = copies, flat[end - n : end].copy()
        if wanted:
            yield from read(at, wanted)

    return map_arrow(dealt, each, schema)


def _placed(level: Level, given: list[tuple]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(ps + at for (_, ps), at in zip(given, level.bounds))])


def _next(asked: DataFrame, texts: DataFrame, length: int, before: int, at: int) -> DataFrame:
    """t, copies, and a level's places and hashes, of texts with the places that stood for repeated windows a level before."""

    def run(ts: pa.Array, own: pa.Array, given: list[tuple]) -> pa.RecordBatch:
        level = Level(own, length, at)
        level.kept(before, _placed(level, given))
        ps, h1, h2 = zip(*level.sent())
        return pa.RecordBatch.from_arrays([ts, pa.array([c for c, _ in given], pa.int64()), _lists(ps, pa.int32()), _lists(h1, pa.int64()), _lists(h2, pa.int64())], ["t", "copies", "ps", "hs", "hs2"])

    return _in_place(asked, texts, run, "t long, copies long, ps array<int>, hs array<long>, hs2 array<long>")


def _cleaned(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """t, n_removed and the text without the windows that start at the places asked: kept words joined by a space."""

    def run(ts: pa.Array, own: pa.Array, given: list[tuple]) -> pa.RecordBatch:
        words, bounds = cut(own, INKED)
        kept, removed = [], []
        for (_, ps), lo, hi in zip(given, bounds.tolist(), bounds[1:].tolist()):
            edge = np.zeros(hi - lo + 1, np.int64)
            np.add.at(edge, ps, 1)
            np.add.at(edge, ps + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(compress(words.slice(lo, hi - lo).to_pylist(), ~gone)).decode() if removed[-1] < hi - lo else "")
        return pa.RecordBatch.from_arrays([ts, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["t", "n_removed", "kept"])

    return _in_place(asked, texts, run, "t long, n_removed long, kept string")


def _repeated(found: DataFrame, label: str, exact: bool) -> DataFrame:
    """t, copies and, of the places in found(t, copies, ps, hs[, hs2]), those whose hash occurs again; texts with copies keep all."""
    zipped = F.arrays_zip("ps", "hs", "hs2") if exact else F.arrays_zip("ps", "hs")
    names = ["h", "g"] if exact else ["h"]
    hashes = [F.col("x.hs").alias("h"), *([F.col("x.hs2").alias("g")] if exact else [])]
    each = found.select("t", "copies", F.explode(zipped).alias("x")).select("t", "copies", F.col("x.ps").alias("p"), *hashes)
    counts = materialise(each.groupBy(*names).agg(F.sum("copies").alias("n"), F.count("*").alias("places")).where("n > 1"), f"{label}-counts")
    total = counts.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    met = skewed_lookup(each.where("copies = 1").drop("copies"), counts.select(*names, "places"), names, "places", total)
    single = met.groupBy("t").agg(F.lit(1).cast("long").alias("copies"), F.collect_list("p").alias("ps"))
    out = materialise(single.unionByName(found.where("copies > 1").select("t", "copies", "ps")), f"{label}-repeated")
    forget(counts)
    return out


def repeated_windows(docs: DataFrame, length: int = 35, shortest: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: a row a document (id, k1, k2, n_words, digest of its words), and a row a different text that loses words
    (k1, k2, copies, n_removed: null if it has copies and loses all, kept: its other words joined by a space)."""
    text = F.coalesce(column(text_col), F.lit("")).alias("text")
    keyed = docs.select(column(id_col).alias("id"), text).select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    lengths = levels(length, shortest)
    lengths = lengths if len(lengths) > 1 else 2 * lengths
    rows = materialise(_first(keyed, length, lengths[0]), "repeats-rows")
    long = rows.where(F.col("n_words") >= length).groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("ps").alias("ps"), F.first("hs").alias("hs"))
    found = materialise(long.withColumn("t", F.monotonically_increasing_id()), "repeats-different")
    names = found.select("t", *KEY, "copies")
    again = _repeated(found, "repeats", False)
    asked = materialise(names.join(again.select("t"), "t"), "repeats-asked")
    given = KeyFilter(asked, "k1").marked(keyed, F.col("k1"), "maybe").where("maybe").groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = materialise(given.join(asked, KEY).select("t", "text"), "repeats-texts")
    for before, at in zip(lengths, lengths[1:]):
        if again.isEmpty():
            break
        level = materialise(_next(again, texts, length, before, at), "repeats-level")
        forget(again)
        again = _repeated(level, "repeats", at == length)
        forget(level)
    whole = F.col("copies") > 1  # every window of a text that has copies repeats
    lost = names.where(whole).select("t", F.lit(None).cast("long").alias("n_removed"), F.lit("").alias("kept"))
    lost = lost.unionByName(_cleaned(again.where(~whole), texts, length))
    out = materialise(lost.join(names, "t").select(*KEY, "copies", "n_removed", "kept"), "repeats-cleaned")
    forget(again, asked, found, texts)
    return rows, out


def without_repeats(docs: DataFrame, length: int = 35, shortest: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (null where all words stay: the text is as it was) and digest (of all words)."""
    rows, found = repeated_windows(docs, length, shortest, id_col, text_col)
    lost = found.select(*KEY, "copies", "n_removed", "kept", F.lit(True).alias("lost"))
    met = skewed_lookup(rows.select("id", *KEY, "n_words", "digest"), lost, KEY, "copies", rows.count(), "left")
    n_removed = F.when(F.col("lost"), F.coalesce("n_removed", "n_words")).otherwise(0).cast("long").alias("n_removed")
    return met.select(F.col("id").alias("doc_id"), "n_words", n_removed, "kept", "digest")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long"), "n_words", "n_removed", F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), "digest").alias("kept_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35
), s AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w
), again AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1
), gone AS (SELECT DISTINCT r, i + j AS i FROM again, range(0, 35) t(j)
), kept AS (
  SELECT r, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS t
  FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d) p LEFT JOIN gone g USING (r, i) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
