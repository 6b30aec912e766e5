"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences with masks, read without copying.

Texts are encoded once, where they are read, and packed ids are shuffled: to the range of doc_id that a bounded sample of
ids and text hashes has set, so that rows that share an id, or have none, are dealt out too. Each partition packs its documents end to end into rows of `length` ids and writes one Arrow file in batches of `rows` rows, so sequence i is batch i // rows, row i % rows: a memory-mapped
reader gets it as a view. Beside it an index file holds each document's place. Ids are 16-bit if the vocabulary allows,
the mask is bit-packed and false in the last row's padding. A file's name holds the attempt that wrote it and only finished tasks
report theirs, so a lost executor or a second attempt never mixes files. Only the list of files, one row a partition,
reaches the driver.

Ids come from the tokenizers library. Each Python worker remembers up to twice MEMO pieces between the places where the
library splits a text, and passes only new ones to its model.

Cases: null text is empty and gives the end id alone; null ids come first; rows that repeat an id are documents of their
own, in the order of a hash of their texts; very long texts fill as many rows as they need; an empty table gives no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.bpe import byte_letters
from rankloom.llm.shared import column, shared_dir, table
from rankloom.llm.textbatch import groups_of, map_arrow

MEMO = 500_000
MOST_KEYS = 1 << 20  # what range_bounds() takes to the driver, 16 bytes each
#: The normalizer and the splitting that PieceEncoder mirrors, as a tokenizers file states them.
MIRRORED = (
    ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
BYTE_LETTERS = byte_letters()


def _kinds() -> np.ndarray:
    """Kinds of Latin-1 characters: 0 white space, 1 letters, 2 numbers, 3 others."""
    out = np.full(256, 3, np.uint8)
    for c in range(256):
        mark = unicodedata.category(chr(c))[0]
        out[c] = 0 if chr(c) in "\t\n\v\f\r " else 1 if mark == "L" else 2 if mark == "N" else 3
    return out


KINDS = _kinds()
#: Characters that piece_starts() leaves to the library: controls, odd spaces, the soft hyphen. Others count as plain.
PLAIN = bytes(c for c in range(256) if c in b"\t\n\v\f\r" or 32 <= c < 127 or c > 160 and c != 173)


def piece_starts(flat: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece, or a run of white space, of lower-cased Latin-1 characters begins at each place."""
    start = np.empty(len(flat), bool)
    start[:1] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero((flat == 39) & start)  # an apostrophe at a piece's start may begin a contraction
    if len(quotes):
        padded = np.concatenate([flat, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 108) & (two == 108)) | (((one == 114) | (one == 118)) & (two == 101))
        start[quotes[short | long] + 1] = False
        after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        start[after[after < len(flat)]] = True
    return start


def plain(text: str) -> bytes | None:
    """The lower-cased text in Latin-1, or nothing if piece_starts() doesn't cover it."""
    if "<|" in text:
        return None
    try:
        raw = text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, PLAIN) else raw


class PieceEncoder:
    """Encodes by a tokenizers file.

    Texts of Latin-1 characters are cut in numpy where the file's normalizer and splitting cut them, Arrow finds the distinct
    pieces, and the library's model encodes those that are not remembered; ids are gathered in numpy. Other texts, and
    files with other rules, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.mirrors = self._mirrors(json.loads(self.tokenizer.to_str()))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _mirrors(spec: dict) -> bool:
        """Whether the file normalizes and splits as piece_starts() does."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if len(steps) != 3 or len(splits) != 2 or spec["model"]["type"] != "BPE":
            return False
        replaces = steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        cut, level = splits
        cuts = cut["type"] == "Split" and cut["pattern"] == {"Regex": MIRRORED[1]} and cut["behavior"] == "Removed" and cut["invert"]
        plain = level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        return [s["type"] for s in steps] == MIRRORED[0] and replaces and cuts and plain and special

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        raws = [plain(t) if self.mirrors else None for t in texts]
        odd = [i for i, r in enumerate(raws) if r is None]
        flat, counts = self._gathered([r for r in raws if r is not None])
        if not odd:
            return flat, counts
        whole = {i: np.array(e.ids, self.dtype) for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False))}
        parts = iter(np.split(flat, np.cumsum(counts)))
        each = [whole[i] if i in whole else next(parts) for i in range(len(texts))]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _gathered(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(raws), np.uint8)
        kind = KINDS[data]
        inked = kind != 0
        start = piece_starts(data, kind)
        starts = np.flatnonzero(start & inked)
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(raws), np.int64)
        data = data[inked]
        offsets = np.append(np.flatnonzero(start[inked]), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        packed = self._packed(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), np.int32, len(packed)) // self.dtype.itemsize
        first = np.cumsum(size, dtype=np.int32) - size
        table = np.frombuffer(b"".join(packed), self.dtype)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        own = size[which]
        ends = np.cumsum(own)
        at = np.repeat(first[which] - (ends - own).astype(np.int32), own)
        at += np.arange(len(at), dtype=np.int32)
        edges = np.cumsum([0, *(len(r) + 1 for r in raws)])  # a text begins after its predecessor's separator
        before = np.concatenate([[0], ends])[np.searchsorted(starts, edges, "left")]
        return table[at], np.diff(before)

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as dtype."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        tokenize, code, swap = self.tokenizer.model.tokenize, self.dtype.char, sys.byteorder == "big"
        for i in [i for i, got in enumerate(out) if got is None]:
            piece = pieces[i]
            got = old.get(piece)
            if got is None:
                letters = piece.decode() if piece.isalpha() else piece.decode("latin-1").encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = array(code, [t.id for t in tokenize(letters)])
                if swap:
                    ids.byteswap()
                got = ids.tobytes()
            out[i] = young[piece] = got
        return out


_LOADED: dict[str, PieceEncoder] = {}


def loaded(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    local = uri.removeprefix("file:") if uri.startswith("file:") else uri if uri.startswith("/") else None
    return pyarrow.fs.FileSystem.from_uri(uri if local is None else f"file:///{local.lstrip('/')}")


class ShardWriter:
    """One Arrow file of sequences and its index."""

    def __init__(self, base: str, dtype: np.dtype, length: int, rows: int, pad: int):
        self.uri, self.dtype, self.length, self.rows, self.pad = base, dtype, length, rows, pad
        files, path = opened(base)
        files.create_dir(os.path.dirname(path), recursive=True)
        ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(ids, length)), ("attention_mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [files.open_output_stream(f"{path}.arrow"), files.open_output_stream(f"{path}.index.arrow")]
        self.data = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held, self.held_ids, self.total, self.docs = [], 0, 0, 0

    def add(self, doc_ids: list[int | None], packed: list[bytes]) -> None:
        counts = [len(b) // self.dtype.itemsize for b in packed]
        starts = (self.total + np.cumsum([0, *counts])[:-1]).astype(np.int64)
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts, pa.int64())], schema=self.index_schema))
        self.held += packed
        self.held_ids += sum(counts)
        self.total += sum(counts)
        self.docs += len(packed)
        self._flush(False)

    def _flush(self, last: bool) -> None:
        full = self.rows * self.length
        if not last and self.held_ids < full:
            return
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        end = len(ids) // full * full
        for at in range(0, end, full):
            self._write(ids[at : at + full], full)
        rest = ids[end:]
        if last and len(rest):
            n = len(rest)
            size = -(-n // self.length) * self.length
            self._write(np.concatenate([rest, np.full(size - n, self.pad, self.dtype)]), n)
            rest = rest[:0]
        self.held, self.held_ids = [rest.tobytes()], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.data, self.index, *self.sinks):
            x.close()


class TokenShard:
    """Random access to one file: sequence(i) is a view into the mapped file."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        local = isinstance(files, pyarrow.fs.LocalFileSystem)
        self.source, self.index_source = (pa.memory_map(p) if local else files.open_input_file(p) for p in (f"{path}.arrow", f"{path}.index.arrow"))
        self.reader, self.index = pa.ipc.open_file(self.source), pa.ipc.open_file(self.index_source)
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.reader.get_batch(i // self.rows)
        ids, mask = (batch.column(k)[i % self.rows].values for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[pa.RecordBatch, list[Iterator[np.ndarray]]]]:
        """Per index batch: its rows, and for each document the stretches of ids that make it up, in order."""
        at, ids, base = -1, np.empty(0, np.uint16), 0

        def stretches(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal at, ids, base
            while n:
                while start >= base + len(ids):
                    base += len(ids)
                    at += 1
                    ids = self.reader.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                part = ids[start - base : start - base + n]
                yield part
                start, n = start + len(part), n - len(part)

        for k in range(self.index.num_record_batches):
            batch = self.index.get_batch(k)
            yield batch, [stretches(s, n) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]


def range_bounds(keys: DataFrame, total: int, parts: int, each: int = 100, most: int = MOST_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """At most parts - 1 bounds (doc_id, h) that cut keys evenly: quantiles of about parts * each keys, at most `most`, taken by hash."""
    share = min(1 << 30, -(-min(most, parts * each) << 30) // max(1, total))
    chosen = keys.where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(1 << 30)) < share).distinct().toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    ids, hashes = chosen.column("doc_id").to_numpy(), chosen.column("h").to_numpy()
    at = np.unique(np.arange(1, parts) * len(ids) // parts) if len(ids) else np.empty(0, np.int64)
    return ids[at], hashes[at]


def place(bounds: tuple[np.ndarray, np.ndarray], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many bounds are not above each (id, hash)."""
    low, high = np.searchsorted(bounds[0], ids, "left"), np.searchsorted(bounds[0], ids, "right")
    for i in np.flatnonzero(high > low):  # bounds with the same id
        high[i] = low[i] + np.searchsorted(bounds[1][low[i] : high[i]], hashes[i], "right")
    return high


def write_token_files(docs: DataFrame, path: str, target: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 2048, rows: int = 64, shard_bytes: int = 64_000_000) -> list:
    """Write the files below `target`; returns (shard, uri, n_docs, n_tokens) a file, in order of doc_id.

    There are as many files as shuffle partitions, and more where a shard's texts would hold over `shard_bytes`, up to one
    for 4 of the MOST_KEYS sampled keys: beyond some 16 TB of texts, files grow instead.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    least = -(1 << 63)  # where null ids go
    keyed = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(id_col).cast("long"), F.lit(least)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_KEYS // 4, -(-size // shard_bytes)))
    bounds = range_bounds(keyed.select("doc_id", "h"), total, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            for part in groups_of(batch, 3):
                flat, counts = encoder.encode(part.column(3).to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * encoder.dtype.itemsize
                ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                shard = place(bounds, part.column(1).to_numpy(), part.column(2).to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(shard), ids], ["doc_id", "h", "shard", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = ShardWriter(f"{target}/part-{shard:06d}-{uuid.uuid4().hex}", loaded(path).dtype, length, rows, end_id)
            for part in groups_of(batch, 1):
                writer.add(part.column(0).to_pylist(), part.column(1).to_pylist())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": writer.uri, "n_docs": writer.docs, "n_tokens": writer.total}])

    found = map_arrow(keyed, encode, "doc_id long, h long, shard int, ids binary")
    ordered = found.repartitionById(parts, "shard").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    files = sorted(map_arrow(ordered, write, "shard long, uri string, n_docs long, n_tokens long").collect())
    _drop_others(docs.sparkSession, target, {f["uri"].rsplit("/", 1)[1] for f in files})
    return files


def _drop_others(spark: SparkSession, target: str, kept: set[str]) -> None:
    """Delete what attempts have left that didn't finish."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(folder) if fs.exists(folder) else ():
        if found.getPath().getName().split(".")[0] not in kept:
            fs.delete(found.getPath(), False)


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32, read back from the files."""
    start, rows = 0, []
    for f in files:
        rows.append((f["uri"], start))
        start += f["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns)):
                for index, docs in TokenShard(uri).documents():
                    sums = []
                    for parts in docs:
                        crc = 0
                        for ids in parts:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(index.column(1).to_numpy() + first)
                    yield pa.RecordBatch.from_arrays([index.column(0), starts, index.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "uri string, first long").repartition(max(1, min(len(rows), 10_000)))
    return map_arrow(listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), target)
    return read_token_files(spark, files)
