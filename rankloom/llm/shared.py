"""What the operators of this subpackage share: tables, the shared scratch folder, skew-safe lookups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only on a local master."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:  # with its scheme, so that Python's writers mean the same place as Spark's
        path = spark._jvm.org.apache.hadoop.fs.Path(conf)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_rankloom_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext._rankloom_scratch = own
    return own


MADE: list[str] = []  # the scratch tables of this driver, oldest first


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextlib.contextmanager
def scratch_kept_to(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the scratch tables that are made inside, at the end, but for those put into the list."""
    before, kept = len(MADE), []
    yield kept
    paths = MADE[before:]
    del MADE[before:]
    held = {df.scratch for df in kept}
    MADE.extend(held)
    for path in paths:
        if path not in held:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch)


def column(name: str) -> Column:
    """A column by its name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with as many underscores in front as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def remainder(id_col: str, by: int) -> Column:
    """CRC-32 of the id as text modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; null counts as empty. Pure ASCII texts take the byte-wise path of lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def skewed_lookup(rows: DataFrame, found: DataFrame, on: list[str], size: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join rows to found (one row per key, `size` = the number of rows with that key, `total` rows in all), whatever the skew.

    Keys that hold at least 1/parts of all rows number at most `parts`, so they are broadcast; the other keys are
    small and go through a shuffle join. `how`: inner, or left (rows without a key in found stay).
    """
    is_hot = (F.col(size) > 1) & (F.col(size) * parts >= F.lit(total))
    hot, cold = found.where(is_hot), found.where(~is_hot)
    return rows.join(F.broadcast(hot), on, "inner").unionByName(
        rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    )


class KeyFilter:
    """A bitmap over keys that says of any row whether its key may be among them; sized by the keys, and native.

    It has at least eight bits a key up to 2**most bits (128 MB, in rows of 4 kB); with more keys it only lets more rows
    through, for an exact step to settle.
    """

    def __init__(self, keys: DataFrame, key: str, most: int = 30):
        self.bits = max(15, min(most, (8 * keys.count()).bit_length()))
        at = self._slot(column(key))
        self.table = materialise(keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")), "key-filter")

    def _slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << self.bits)) + 1

    def marked(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a boolean column: false where the key is certainly not among the filter's."""
        probe = rows.withColumn("_slot", self._slot(key)).join(F.broadcast(self.table), F.bitmap_bucket_number("_slot") == F.col("bucket"), "left")
        place = F.bitmap_bit_position("_slot")
        byte = F.conv(F.hex(F.substring("bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
        return probe.withColumn(name, hit).drop("_slot", "bucket", "bitmap")
