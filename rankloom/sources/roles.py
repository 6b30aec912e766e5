"""Roles of the sample tables: which stand for records, assignments, vocabulary, splits and predictions.

Splits are by order key, so that no global sort is needed, and every record has a role: keys ending in 0 are the development
split, which is ranked and scored, all others the training corpus, of which keys ending in 1 are the small one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_RECORDS = 4096  # of popularity_rankings(), so that a task's rows don't grow with the table
PART_LINES = 262_144  # order lines that a task counts at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, type, lang, split."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("type"), F.col("c_mktsegment").alias("lang"),
        (F.col("o_orderkey") % 10).cast("int").alias("split"),
    )


def raw_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, code, split: repeats kept."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("code"), (F.col("l_orderkey") % 10).cast("int").alias("split")
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_assignments(spark, sf_dir).distinct()


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, group, alternate."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("group"), F.col("p_brand").alias("alternate")
    )


def mixed_predictions(spark: SparkSession, sf_dir: str, length: int = 50) -> DataFrame:
    """record_id, rank, code for the development split: two thirds of the gold codes among fillers, in hash order.

    For evaluator queries only: the rankings know the gold codes.
    """
    dev = records(spark, sf_dir).where("split = 0").select("record_id")
    size = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    filler = dev.join(F.broadcast(size)).select(
        "record_id", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("j"), "n"
    ).select("record_id", ((F.col("record_id") * 7919 + F.col("j") * 104729) % F.col("n") + 1).alias("code"))
    gold = assignments(spark, sf_dir).where("split = 0").select("record_id", "code").where((F.col("record_id") + F.col("code")) % 3 != 0)
    key = F.md5(F.concat_ws(":", F.col("record_id").cast("string"), F.col("code").cast("string")).cast("binary"))
    from rankloom.operators.ranking import rank_by

    both = gold.join(dev, "record_id", "left_semi").unionByName(filler).distinct().withColumn("key", key)
    return rank_by(both, ["record_id"], [F.col("key"), F.col("code")], limit=length).select("record_id", "rank", "code")


def dev_parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts the records of the development split, and what meets them by record, are dealt."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").count() // PART_RECORDS))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, code of the development split, dealt by record as popularity_rankings() are."""
    own = raw_assignments(spark, sf_dir).where("split = 0").select("record_id", "code")
    return own.repartition(dev_parts(spark, sf_dir), "record_id").distinct()


def training_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, lang, code, score: in how many training records of the cell each code stands.

    Lines are dealt by record and then by language and code, each time into parts of about PART_LINES, and counted where they
    lie, so that neither a split of a file nor the number of shuffle partitions says how much a task holds.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // PART_LINES))
    train = raw_assignments(spark, sf_dir).where("split between 1 and 9").select("record_id", "code").repartition(parts, "record_id").distinct()
    cells = records(spark, sf_dir).where("split between 1 and 9").select("record_id", "type", "lang").repartition(parts, "record_id")
    dealt = train.join(cells, "record_id").repartition(parts, "lang", "code")
    return dealt.groupBy("type", "lang", "code").agg(F.count("*").cast("double").alias("score"))


def popularity_rankings(spark: SparkSession, sf_dir: str, depth: int = 30) -> DataFrame:
    """record_id, source, rank, code, score for the development split, from training counts alone.

    cell: popular within the record's type and language; lang: within its language; hash: pseudo-random codes.

    Records are dealt by their ids into parts of about PART_RECORDS, and only then take their lists: the lists of types and
    languages, a row of `depth` codes each, are broadcast. So no task gets a whole language, and what works by record afterwards
    finds each record's rows in one part.
    """
    from rankloom.operators.ranking import rank_by

    dev = records(spark, sf_dir).where("split = 0").select("record_id", "type", "lang")
    by_cell = training_counts(spark, sf_dir)
    by_lang = by_cell.groupBy("lang", "code").agg(F.sum("score").alias("score"))  # lies by language and code already

    def lists(counts: DataFrame, by: list[str], name: str) -> DataFrame:
        """Keys are one struct: joins then ask for no rows without nulls, and both lists are drawn from the same shuffle."""
        top = rank_by(counts, by, [F.desc("score"), F.col("code")], limit=depth)
        each = F.collect_list(F.struct(F.lit(name).alias("source"), "rank", "code", "score")).alias(f"of_{name}")
        return F.broadcast(top.groupBy(*by).agg(each).select(F.struct(*by).alias(f"key_{name}"), f"of_{name}"))

    size = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    dealt = dev.repartition(dev_parts(spark, sf_dir), "record_id").withColumn("key_cell", F.struct("type", "lang")).withColumn("key_lang", F.struct("lang"))
    own = dealt.join(lists(by_cell, ["type", "lang"], "cell"), "key_cell", "left").join(lists(by_lang, ["lang"], "lang"), "key_lang", "left")
    own = own.join(F.broadcast(size)).withColumn("first", F.row_number().over(W.partitionBy("record_id").orderBy("type", "lang")) == 1)
    codes = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda j: (F.col("record_id") * 31 + j * 613) % F.col("n") + 1)
    own = own.withColumn("codes", codes).withColumn("distinct", F.array_distinct("codes"))
    at = lambda code, i: F.when(F.size("distinct") == depth, i + 1).otherwise(F.array_position("codes", code))
    hashed = F.transform("distinct", lambda code, i: F.struct(F.lit("hash").alias("source"), i.cast("int").alias("rank"), code.alias("code"), (F.lit(1.0) / at(code, i)).alias("score")))
    none = F.slice(hashed, 1, 0)
    known = lambda name, *by: F.coalesce(F.when(F.concat(*by).isNotNull(), F.col(f"of_{name}")), none)
    each = F.concat(known("cell", "type", "lang"), known("lang", "lang"), F.when(F.col("first"), hashed).otherwise(none))  # ids that repeat have one list of hashed codes
    return own.select("record_id", F.inline(each)).select("record_id", "source", "rank", "code", "score")


ROLES_SQL = """
records AS (
  SELECT o_orderkey AS record_id, o_orderpriority AS type, c_mktsegment AS lang, CAST(o_orderkey % 10 AS INTEGER) AS split
  FROM orders JOIN customer ON o_custkey = c_custkey
), raw_assignments AS (
  SELECT l_orderkey AS record_id, l_partkey AS code, CAST(l_orderkey % 10 AS INTEGER) AS split FROM lineitem
), assignments AS (SELECT DISTINCT * FROM raw_assignments), vocabulary AS (
  SELECT p_partkey AS code, p_name AS name, p_type AS "group", p_brand AS alternate FROM part
), dev AS (SELECT record_id, type, lang FROM records WHERE split = 0), n_parts AS (SELECT count(*) AS n FROM part)"""

MIXED_SQL = ROLES_SQL + """, mixed_all AS (
  SELECT record_id, code FROM assignments WHERE split = 0 AND (record_id + code) % 3 <> 0 AND record_id IN (SELECT record_id FROM dev)
  UNION
  SELECT record_id, (record_id * 7919 + j * 104729) % n + 1 FROM dev, n_parts, range(1, 51) t(j)
), mixed AS (
  SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY md5(record_id || ':' || code), code) - 1 AS INTEGER) AS rank, code
  FROM mixed_all
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY md5(record_id || ':' || code), code) <= 50
)"""

POPULARITY_SQL = ROLES_SQL + """, train AS (
  SELECT record_id, code, type, lang FROM assignments a JOIN records r USING (record_id) WHERE a.split BETWEEN 1 AND 9
), by_cell AS (
  SELECT type, lang, code, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY type, lang ORDER BY count(*) DESC, code) - 1 AS rank
  FROM train GROUP BY type, lang, code
), by_lang AS (
  SELECT lang, code, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, code) - 1 AS rank
  FROM train GROUP BY lang, code
), hashed AS (
  SELECT record_id, code, max(score) AS score
  FROM (SELECT record_id, (record_id * 31 + j * 613) % n + 1 AS code, 1.0::DOUBLE / j AS score FROM dev, n_parts, range(1, 31) t(j)) GROUP BY record_id, code
), rankings AS (
  SELECT record_id, 'cell' AS source, CAST(rank AS INTEGER) AS rank, code, score FROM dev JOIN by_cell USING (type, lang) WHERE rank < 30
  UNION ALL SELECT record_id, 'lang', CAST(rank AS INTEGER), code, score FROM dev JOIN by_lang USING (lang) WHERE rank < 30
  UNION ALL SELECT record_id, 'hash', CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code) - 1 AS INTEGER), code, score FROM hashed
)"""
