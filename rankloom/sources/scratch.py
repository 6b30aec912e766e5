"""The folder that driver and executors share, and tables that are stored there once."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, with its scheme; on a local master without one, a temporary folder of this session."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return _qualified(spark, conf)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_rankloom_store", None)
    if own is None:
        own = spark.sparkContext._rankloom_store = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    return own


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stamp(spark: SparkSession, path: str, **depends) -> str:
    """16 hex digits over a table's files (names, sizes, times of change) and whatever else a stored table depends on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hashlib.sha256(json.dumps([sorted(found), depends], sort_keys=True).encode()).hexdigest()[:16]


def stored(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The path of a stored thing of that name, which build(path) writes the first time.

    It is written beside its place and moved there when it is complete, so a failed or a second build never leaves half of it.
    """
    root = shared_folder(spark)
    path = f"{root}/{name}"
    if not exists(spark, path):
        half = f"{root}/.{uuid.uuid4().hex}-{name.replace('/', '-')}"
        build(half)
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (half, path))
        files = source.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target.getParent())
        if exists(spark, path) or not files.rename(source, target):  # another build was first
            files.delete(source, True)
    return path


def write_once(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of write_once() that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
