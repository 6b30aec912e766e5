"""Exact nearest neighbours by inner product, and the code rankings drawn from them.

The index is stored in blocks of bounded size (vector_index); a task reads a block in place, streams queries past it, one
matrix product a batch, and keeps only the best rows of each query. No pair of vectors is ever a row. Ids are of any type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.ranking import rank_by
from rankloom.operators.vector_index import VectorIndex, build_index, open_index, search
from rankloom.sources.scratch import stored


def finite(vector: Column, key: Column) -> Column:
    """The vector; an error that names the row where it or a component is null or not finite."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(bad, F.raise_error(F.concat(F.lit("no finite vector for "), F.coalesce(key.cast("string"), F.lit("null"))))).otherwise(vector)


def normalised(vector: Column) -> Column:
    """The vector at length 1, as doubles; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm == 0, x).otherwise(x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def indexable(rows: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """id, v: what a vector index takes; rows without a finite vector are refused when it is run."""
    return rows.select(F.col(key).alias("id"), F.transform(finite(F.col(vector), F.col(key)), lambda x: x.cast("double")).alias("v"))


def stored_index(index: DataFrame, name: str, key: str = "id", vector: str = "vector", block: int = 65_536) -> VectorIndex:
    """The index of that name in the shared folder, built the first time. The name says what it depends on (see scratch.stamp)."""
    rows = indexable(index, key, vector)
    path = stored(index.sparkSession, name, lambda half: build_index(rows, half, block))
    return open_index(index.sparkSession, path, rows.schema["id"].dataType.simpleString())


def nearest(queries: DataFrame, index: DataFrame | VectorIndex, k: int, query_key: str = "id", index_key: str = "id", vector: str = "vector", decimals: int = 6, exclude_self: bool = False, block: int = 65_536) -> DataFrame:
    """query, id, sim, rank: the k most similar index rows of each query, similarity rounded, ties by id.

    The index is a stored one, or rows of which one is built for this search. Vectors that are null or hold a component
    that is null or not finite are refused.
    """
    if isinstance(index, DataFrame):
        index = stored_index(index, f"vectors-{uuid.uuid4().hex}", index_key, vector, block)
    return search(index, indexable(queries, query_key, vector), k, decimals, exclude_self)


def harvest(neighbours: DataFrame, subjects: DataFrame, depth: int) -> DataFrame:
    """query, code, score: each code's similarities (none below 0) summed over the first `depth` neighbours; codes at 0 stay."""
    near = neighbours.where(F.col("rank") < depth).join(subjects.select("id", "code").distinct(), "id")
    return near.groupBy("query", "code").agg(F.round(F.sum(F.greatest("sim", F.lit(0.0))), 6).alias("score"))


def ranked_codes(scores: DataFrame, limit: int | None = None) -> DataFrame:
    return rank_by(scores, ["query"], [F.desc("score"), F.col("code")], limit=limit)


def fill(neighbours: DataFrame, subjects: DataFrame, depth: int, wanted: int, gap: float = 1e-6) -> DataFrame:
    """query, code, score, phase, rank: the harvest, then codes of deeper neighbours until `wanted` codes are there.

    Deeper neighbours are walked in order up to the one at which enough new codes have been seen; their codes are scored
    like the harvest and shifted below its lowest score by `gap`.
    """
    first = harvest(neighbours, subjects, depth)
    stats = first.groupBy("query").agg(F.count("*").alias("have"), F.min("score").alias("low"))
    deeper = neighbours.where(F.col("rank") >= depth).join(subjects.select("id", "code").distinct(), "id")
    new = deeper.join(first.select("query", "code"), ["query", "code"], "left_anti").join(stats, "query", "left")
    new = new.withColumn("have", F.coalesce("have", F.lit(0)))
    seen = new.groupBy("query", "have", "code").agg(F.min("rank").alias("at"))
    counted = seen.withColumn("seen", F.count("*").over(W.partitionBy("query").orderBy("at").rangeBetween(W.unboundedPreceding, 0)))
    need = F.lit(wanted) - F.col("have")
    stop = counted.groupBy("query", "have").agg(F.min(F.when(F.col("seen") >= need, F.col("at"))).alias("stop"), F.max("at").alias("deepest"))
    stop = stop.where(need > 0).select("query", F.coalesce("stop", "deepest").alias("stop"))
    used = new.join(stop, "query").where(F.col("rank") <= F.col("stop"))
    extra = used.groupBy("query", "code").agg(F.round(F.sum(F.greatest("sim", F.lit(0.0))), 6).alias("score"), F.first("low").alias("low"))
    best = F.max("score").over(W.partitionBy("query"))
    shift = F.coalesce(F.col("low") - F.lit(gap) - best, F.lit(0.0))
    extra = extra.withColumn("score", F.round(F.col("score") + shift, 6)).select("query", "code", "score", F.lit(1).alias("phase"))
    both = first.withColumn("phase", F.lit(0)).unionByName(extra)
    return rank_by(both, ["query"], [F.col("phase"), F.desc("score"), F.col("code")], limit=wanted)


def centroids(vectors: DataFrame, label: str = "code") -> DataFrame:
    """id (the label) and vector: the normalised mean of each label's vectors, components rounded to 6 places."""
    parts = vectors.select(F.col(label).alias("id"), F.posexplode("vector").alias("pos", "x"))
    means = parts.groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v"))
    return packed.select("id", F.transform(normalised(F.col("v")), lambda x: F.round(x, 6)).alias("vector"))
