"""Label strings that are looked up: translations of terms and their qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T


def translate(terms: DataFrame, term: Column, mode: str, words: DataFrame, separator: str = ",") -> DataFrame:
    """terms with english: base and qualifier looked up on their own in words(german, english).

    Null without a translated base; a qualifier without a translation keeps its German form.
    """
    own = terms.withColumn("_b", T.base_term(term)).withColumn("_q", T.qualifier_of(term))
    look = lambda key, found: words.select(F.col("german").alias(key), F.col("english").alias(found))
    own = own.join(look("_b", "_eb"), "_b", "left").join(look("_q", "_eq"), "_q", "left")
    q = F.when(F.coalesce("_eq", F.lit("")) != "", F.col("_eq")).otherwise(F.col("_q"))
    return own.withColumn("english", F.when(F.coalesce("_eb", F.lit("")) != "", T.join_term(F.col("_eb"), q, separator, mode))).drop("_b", "_q", "_eb", "_eq")


def required(terms: DataFrame, term: Column, group: str) -> DataFrame:
    """string: the distinct strings that translating the terms and their groups needs."""
    parts = F.array_compact(F.array(F.col(group), T.base_term(term), T.qualifier_of(term)))
    return terms.select(F.explode(parts).alias("string")).distinct()


def cache_coverage(need: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: strings required, those cached, those missing, and cached ones that nothing needs; cache(string)."""
    both = need.withColumn("needed", F.lit(1)).join(cache.select("string", F.lit(1).alias("cached")), "string", "full")
    return both.agg(
        F.count("needed").alias("required"), F.count_if(F.col("needed").isNotNull() & F.col("cached").isNotNull()).alias("cached"),
        F.count_if(F.col("cached").isNull()).alias("missing"), F.count_if(F.col("needed").isNull()).alias("stale"),
    )


def count_qualified(entries: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """One row: entries, how many have a qualifier in each of the named columns, and in any of them."""
    has = {name: T.qualifier_of(c).isNotNull() for name, c in terms.items()}
    some = F.greatest(*(c.cast("int") for c in has.values())) == 1
    return entries.agg(F.count("*").alias("entries"), *(F.count_if(c).alias(name) for name, c in has.items()), F.count_if(some).alias("any_field"))
