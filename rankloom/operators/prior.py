"""Group priors: which group of codes a record belongs to, and lifting the candidates of likely groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.heads import fit, labelled
from rankloom.operators.ranking import rank_by
from rankloom.operators.vectors import dot
from rankloom.sources.scratch import discard, write_once


def group_of_code(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where("trim(group) <> ''").select("code", "group")


def record_groups(gold: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id, group: distinct true groups."""
    return gold.join(groups, "code").select("record_id", "group").distinct()


def distributions(vectors: DataFrame, head: DataFrame, most: int = 100_000) -> DataFrame:
    """id, group, p: sigmoids of head(group, coefficients, intercept) over vectors(id, vector), normalised to sum 1 (uniform at 0).

    The head travels as one row, which is refused beyond `most` groups; a vector's groups are one array until the end.
    """
    groups = head.count()
    if groups > most:
        raise ValueError(f"a head of {groups} groups; at most {most}")
    whole = head.agg(F.sort_array(F.collect_list(F.struct("group", "coefficients", "intercept"))).alias("head"))
    sigmoid = lambda h: 1 / (1 + F.exp(-F.round(dot(F.col("vector"), h["coefficients"]) + h["intercept"], 9)))
    own = vectors.join(F.broadcast(whole)).withColumn("s", F.transform("head", lambda h: F.struct(h["group"].alias("group"), sigmoid(h).alias("s"))))
    own = own.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["s"]))
    each = own.select("id", "total", F.size("s").alias("n"), F.explode("s").alias("x"))
    return each.select("id", "x.group", F.when(F.col("total") == 0, 1 / F.col("n")).otherwise(F.col("x.s") / F.col("total")).alias("p"))


def sorted_groups(vocabulary: DataFrame) -> DataFrame:
    """group, position: the distinct groups in order. A row a group."""
    return rank_by(group_of_code(vocabulary).select("group").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.col("group")], name="position").drop("_all")


def fit_facts(records: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: documents, those with a group, the groups they have, all groups, documents per group."""
    n = records.agg(F.count("*").alias("documents"))
    own = truth.join(records.select("record_id"), "record_id", "left_semi").agg(F.countDistinct("record_id").alias("covered"), F.countDistinct("group").alias("present"))
    whole = groups.select("group").distinct().agg(F.count("*").alias("groups"))
    return n.join(own).join(whole).withColumn("per_group", F.col("documents") / F.greatest("groups", F.lit(1)))  # one row each


def boost(candidates: DataFrame, distribution: DataFrame, groups: DataFrame, weight: float) -> DataFrame:
    """candidates(record_id, code, score) with score + weight * (max - min) * P(group), ranked again; never adds or drops."""
    w = W.partitionBy("record_id")
    spread = candidates.withColumn("spread", F.max("score").over(w) - F.min("score").over(w))
    p = distribution.select(F.col("id").alias("record_id"), "group", "p")
    lifted = spread.join(groups, "code", "left").join(p, ["record_id", "group"], "left")
    score = F.round(F.col("score") + F.lit(weight) * F.col("spread") * F.coalesce("p", F.lit(0.0)), 9)
    return rank_by(lifted.select("record_id", "code", score.alias("score")), ["record_id"], [F.desc("score"), F.col("code")])


def sweep_boost(candidates: DataFrame, distribution: DataFrame, groups: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """boost() at each of the weights, in a column w: one plan, whose candidates meet their groups once."""
    w = W.partitionBy("record_id")
    spread = candidates.withColumn("spread", F.max("score").over(w) - F.min("score").over(w))
    p = distribution.select(F.col("id").alias("record_id"), "group", "p")
    lifted = spread.join(groups, "code", "left").join(p, ["record_id", "group"], "left").withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    score = F.round(F.col("score") + F.col("w") * F.col("spread") * F.coalesce("p", F.lit(0.0)), 9)
    return rank_by(lifted.select("w", "record_id", "code", score.alias("score")), ["record_id", "w"], [F.desc("score"), F.col("code")])


def accuracy(distribution: DataFrame, truth: DataFrame, depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """depth, records, any_within, all_within, groups_per_record; records without truth are left out."""
    ranked = rank_by(distribution, ["id"], [F.desc(F.round("p", 9)), F.col("group")])
    own = ranked.join(truth.select(F.col("record_id").alias("id"), "group"), ["id", "group"]).groupBy("id").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")
    )
    spread = own.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    share = lambda c: F.avg(F.when(F.col(c) < F.col("depth"), 1.0).otherwise(0.0))
    return spread.groupBy("depth").agg(F.count("*").alias("records"), share("first").alias("any_within"), share("last").alias("all_within"), F.avg("n").alias("groups_per_record"))


def fit_head(vectors: DataFrame, truth: DataFrame, groups: list[str], c: float = 1.0, iterations: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """group, coefficients, intercept: one logistic regression per group, all fitted together (see heads).

    A row without any group counts against all of them; groups that all rows or none belong to get intercept +-20.
    """
    data = write_once(labelled(vectors, truth, groups), "heads")
    rows = fit(data, groups, c, iterations, tolerance)
    discard(data)
    return vectors.sparkSession.createDataFrame(rows, "group string, coefficients array<double>, intercept double")


def head_totals(vectors: DataFrame, head: DataFrame) -> DataFrame:
    """group, predicted: how many of the vectors the head expects in each group, the sum of its sigmoids."""
    sigmoid = lambda h: 1 / (1 + F.exp(-(dot(F.col("vector"), h["coefficients"]) + h["intercept"])))
    whole = head.agg(F.collect_list(F.struct("group", "coefficients", "intercept")).alias("head"))  # one row, a struct a group
    each = vectors.join(F.broadcast(whole)).select(F.explode(F.transform("head", lambda h: F.struct(h["group"].alias("group"), sigmoid(h).alias("p")))).alias("x"))
    return each.groupBy("x.group").agg(F.sum("x.p").alias("predicted"))
