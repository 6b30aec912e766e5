"""JSON files of any size, cut into the entries of their top-level map or list by tasks.

A file is read in ranges of bytes, twice. The first time a task counts a range's quotes that no backslash escapes, and by
how much brackets outside strings change the depth, both for a range that starts inside a string and for one that doesn't.
Sums over the ranges before then tell how each one starts. The second time a task finds the commas at depth 1 (and the
opening bracket), and hands on what stands between each and the next, reading on beyond its range where an entry does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.sources.digests import files_below
from rankloom.sources.scratch import write_once

OPEN, SHUT, COMMA, QUOTE, SLASH = b"{[", b"}]", 44, 34, 92


def structure(data: np.ndarray, slashes: int, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of the brackets and commas outside strings, and how many quotes begin or end a string.

    slashes: how many backslashes stand right before the data; inside: 1 if the data start inside a string.
    """
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data == SLASH, -1, at)) if len(data) else at
    quotes = np.flatnonzero(data == QUOTE)
    before = quotes - 1
    last = np.where(before >= 0, other[np.maximum(before, 0)], -1)
    run = before - last + np.where(last < 0, slashes, 0)
    real = quotes[run % 2 == 0]
    marks = np.flatnonzero(np.isin(data, np.frombuffer(OPEN + SHUT + b",", np.uint8)))
    marks = marks[(np.searchsorted(real, marks) + inside) % 2 == 0]
    return marks, data[marks], len(real)


def steps(kinds: np.ndarray) -> np.ndarray:
    """1 for brackets that open, -1 for those that close."""
    return np.isin(kinds, np.frombuffer(OPEN, np.uint8)).astype(np.int64) - np.isin(kinds, np.frombuffer(SHUT, np.uint8))


def _slashes(source, at: int) -> int:
    """How many backslashes stand right before a place in a file."""
    back, width = 0, 64
    while at - back > 0:
        size = min(width, at - back)
        data = source.read_at(size, at - back - size)
        own = len(data) - len(data.rstrip(b"\\"))
        back += own
        if own < len(data):
            break
        width *= 4
    return back


def _cut(source, size: int, start: int, length: int, inside: int, depth: int) -> Iterator[bytes]:
    """The entries whose separator (a comma at depth 1, or the bracket that opens it) stands in the range."""
    at, slashes, held, open_ = start, _slashes(source, start), [], False
    while at < size and (at < start + length or open_):
        data = source.read_at(min(length, size - at), at)
        flat = np.frombuffer(data, np.uint8)
        marks, kinds, quotes = structure(flat, slashes, inside)
        after = depth + np.cumsum(steps(kinds))
        begins = (after == 1) & ((kinds == COMMA) | np.isin(kinds, np.frombuffer(OPEN, np.uint8)))
        ends = ((after == 1) & (kinds == COMMA)) | (after == 0)
        from_ = 0
        for place, begin, end in zip(marks[begins | ends].tolist(), begins[begins | ends].tolist(), ends[begins | ends].tolist()):
            if end and open_:
                held.append(data[from_:place])
                yield b"".join(held)
                held, open_ = [], False
            if begin:
                if at >= start + length:
                    return  # of another range
                held, open_, from_ = [], True, place + 1
        if open_:
            held.append(data[from_:])
        inside, depth = (inside + quotes) % 2, int(after[-1]) if len(after) else depth
        own = len(data) - len(data.rstrip(b"\\"))
        slashes = own + (slashes if own == len(data) else 0)
        at += len(data)


def json_entries(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """path, keyed, value: the entries of each file's top-level map (keyed, value `"key": ...`) or list, as they stand in the file."""
    listed, files = files_below(spark, [path]), []
    if not listed:
        raise FileNotFoundError(path)
    for uri, _, size in listed:
        system, where = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_file(where) as source:
            files.append((uri, size, source.read_at(min(size, 4096), 0).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{")))
    ranges = spark.createDataFrame(files, "uri string, size long, keyed boolean").where("size > 0")
    ranges = ranges.select("*", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes})")).alias("part"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    opened = lambda uri: (lambda x: x[0].open_input_file(x[1]))(pyarrow.fs.FileSystem.from_uri(uri))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = []
            for uri, size, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                with opened(uri) as source:
                    data = np.frombuffer(source.read_at(min(range_bytes, size - part * range_bytes), part * range_bytes), np.uint8)
                    slashes = _slashes(source, part * range_bytes)
                found = [structure(data, slashes, inside) for inside in (0, 1)]
                facts.append((found[0][2], *(int(steps(kinds).sum()) for _, kinds, _ in found)))
            columns = [pa.array(x, pa.int64()) for x in zip(*facts)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["uri", "size", "keyed", "part", "quotes", "outside", "inside"])

    counted = ranges.repartition(tasks, "uri", "part").mapInArrow(count, "uri string, size long, keyed boolean, part long, quotes long, outside long, inside long")
    before = W.partitionBy("uri").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    known = write_once(counted, "json-ranges").withColumn("within", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    depth = F.coalesce(F.sum(F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0))
    known = known.select("uri", "size", "keyed", "part", "within", depth.alias("depth"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, keyed, part, within, depth in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(uri) as source:
                    held, total = [], 0
                    for entry in _cut(source, size, part * range_bytes, range_bytes, within, depth):
                        if entry.strip():
                            held.append(entry.decode())
                            total += len(entry)
                        if total > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(held)), pa.array([keyed] * len(held)), pa.array(held)], ["path", "keyed", "value"])
                            held, total = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(held)), pa.array([keyed] * len(held)), pa.array(held)], ["path", "keyed", "value"])

    return known.repartition(tasks, "uri", "part").mapInArrow(cut, "path string, keyed boolean, value string")
