"""Digests of files of any size: chunks are hashed by tasks where they lie and folded in order, level by level.

A file's digest is that of a tree: SHA-256 of each chunk of CHUNK bytes, then of each FAN digests in a row joined in hexadecimal,
until one is left. It depends on the file's bytes alone, not on how the file is cut into ranges for tasks. A task holds one
chunk, and no row more than FAN digests. An empty file is one empty chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
FAN = 1024


def files_below(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, int]]:
    """(uri, name, size) of the files at or below the paths that exist; the name is the path from the given path's own name on."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            continue
        base, each = system.makeQualified(where).toString().rstrip("/"), system.listFiles(where, True)
        while each.hasNext():
            f = each.next()
            uri = f.getPath().toString()
            name = base.rsplit("/", 1)[1] + uri[len(base) :]
            found.append((f"file:///{uri.removeprefix('file:').lstrip('/')}" if uri.startswith("file:") else uri, name, f.getLen()))
    return sorted(found, key=lambda f: f[1])


def file_digests(spark: SparkSession, paths: list[str], range_bytes: int = 64 * CHUNK) -> DataFrame:
    """name, size, digest of every file at or below the paths."""
    each = max(1, range_bytes // CHUNK)
    listed = files_below(spark, paths)
    files = spark.createDataFrame(listed, "uri string, name string, size long")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("long")
    ranges = files.select("uri", "name", "size", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(greatest(1, cast(ceil(size / {CHUNK}) as long)) - 1) div {each}"))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, name, size, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = pyarrow.fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as source:
                    at = list(range(part * each, min(n, (part + 1) * each)))
                    digests = [hashlib.sha256(source.read_at(min(CHUNK, size - k * CHUNK), k * CHUNK)).hexdigest() for k in at]
                columns = [pa.array([name] * len(at)), pa.array([size] * len(at), pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "size", "left", "at", "digest"])

    tasks = spark.sparkContext.defaultParallelism
    level = ranges.repartition(4 * tasks, "uri", "part").mapInArrow(run, "name string, size long, left long, at long, digest string")
    most = max((-(-size // CHUNK) for _, _, size in listed), default=1)
    while most > 1:
        level = level.groupBy("name", "size", F.expr(f"(left + {FAN - 1}) div {FAN}").alias("fewer"), F.expr(f"at div {FAN}").alias("up"), F.col("left").alias("was")).agg(
            F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("own")
        )  # at most FAN digests a row
        joined = F.sha2(F.array_join(F.transform("own", lambda x: x["digest"]), "").cast("binary"), 256)
        level = level.select("name", "size", F.when(F.col("was") > 1, F.col("fewer")).otherwise(1).alias("left"), F.col("up").alias("at"), F.when(F.col("was") > 1, joined).otherwise(F.col("own")[0]["digest"]).alias("digest"))
        most = -(-most // FAN)
    return level.select("name", "size", "digest")
