"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

1. One scan groups rows by length and hash of the first `prefix_chars` characters; groups of one are done.
2. The surviving groups become a bitmap of eight bits a group or more (KeyFilter), the only thing that is broadcast.
3. A second scan reads the full content of rows that the bitmap lets through, hashes it with SHA-256 and groups by
   (length, full hash). A row let through by chance only goes through this exact step needlessly.

exact_dedup() puts no text through a shuffle. Counts are pre-aggregated, so one group of copies may hold any share of the rows.

Cases: null text is the empty text; texts that differ in the case of A-Z alone are equal; of equal texts the largest
doc_id stays (null ids are smallest); rows that repeat an id and a text are rows of their own, of which one stays; very
long texts are hashed where they are read; an empty table gives an empty result; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import KeyFilter, ascii_lower, column, columns, forget, materialise, skewed_lookup, table


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """row (all of docs' columns), id, text (nulls empty), n (its length) and p (the hash of length and prefix)."""
    text = F.coalesce(column(text_col), F.lit(""))
    prefix = F.xxhash64(F.char_length(text), ascii_lower(F.substring(text, 1, prefix_chars)))
    return docs.select(F.struct(*columns(docs)).alias("row"), column(id_col).alias("id"), text.alias("text"), F.char_length(text).alias("n"), prefix.alias("p"))


def _marked(keyed: DataFrame) -> DataFrame:
    """keyed with `maybe`: whether a row's length and prefix hash may be another's too."""
    shared = materialise(keyed.groupBy("p").count().where("count > 1").select("p"), "dedup-prefixes")
    marked = KeyFilter(shared, "p").marked(keyed, F.col("p"), "maybe")
    forget(shared)
    return marked


def _full() -> Column:
    return F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_unique: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, full_hash (null where no full content was read).

    hash_unique: also hash the texts that an earlier step showed to be unique.
    """
    marked = _marked(_keyed(docs.select(column(id_col), column(text_col)), id_col, text_col, prefix_chars))
    full = marked.where("maybe").select("id", "n", _full().alias("full_hash"), F.monotonically_increasing_id().alias("at"))
    full = materialise(full, "dedup-full")
    groups = full.groupBy("n", "full_hash").agg(F.max(F.struct("id", "at")).alias("first"), F.count("*").alias("group_size"))
    resolved = skewed_lookup(full, groups, ["n", "full_hash"], "group_size", full.count())
    unique = marked.where("not maybe").select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (_full() if hash_unique else F.lit(None).cast("string")).alias("full_hash"),
    )
    kept = (F.col("at") == F.col("first.at")).alias("kept")
    return resolved.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size", kept, "full_hash").unionByName(unique)


def drop_exact_copies(docs: DataFrame, prefix_chars: int = 256) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay. Rows that share no length and prefix hash pass without a shuffle.

    Of rows that repeat an id and a text too one stays: the least by a hash of their other columns.
    """
    marked = _marked(_keyed(docs, "doc_id", "text", prefix_chars))
    same_id = F.to_json(F.struct("id")).alias("same_id")  # no null, so that it can be joined on
    full = marked.where("maybe").select("id", same_id, "n", _full().alias("full_hash"))
    survivors = materialise(full.groupBy("n", "full_hash", "id", "same_id").agg(F.count("*").alias("times")), "dedup-survivors")
    stay = survivors.groupBy("n", "full_hash").agg(F.max(F.struct("id", "same_id", "times")).alias("x")).select("n", "full_hash", "x.same_id", "x.times")
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    look = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    own = marked.where("maybe").select("row", "n", _full().alias("full_hash"), same_id)
    met = skewed_lookup(own, stay, ["n", "full_hash", "same_id"], "times", marked.count())
    first = met.where("times > 1").groupBy("same_id", "full_hash").agg(F.min_by("row", look).alias("row"))
    parts = [marked.where("not maybe"), met.where("times = 1"), first]
    return parts[0].select("row.*").unionByName(parts[1].select("row.*")).unionByName(parts[2].select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), hash_unique=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h
"""
