"""BM25 and sparse-weight retrieval: weighted postings in long form, kept in a stored index (lexical_index)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators.lexical_index import LexicalIndex, build_index, open_index, search
from rankloom.operators.ranking import skewed_lookup
from rankloom.sources.scratch import stored, write_once

K1, B = 1.2, 0.75


def postings(entries: DataFrame) -> DataFrame:
    """entry, code, term, tf, len from entries(entry, code, text); entries without terms are not indexed."""
    own = entries.select("entry", "code", tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    return own.select("entry", "code", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("entry", "code", "len", "term").agg(F.count("*").alias("tf"))


def bm25_weights(posted: DataFrame) -> DataFrame:
    """postings with their BM25 weight; N, average length and df are over entries."""
    posted = write_once(posted, "postings")  # the text is cut into terms once
    sizes = posted.select("entry", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = write_once(posted.groupBy("term").agg(F.countDistinct("entry").alias("df"), F.count("*").alias("rows")), "term-counts")
    total = df.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = skewed_lookup(posted, df, ["term"], "rows", total).join(F.broadcast(sizes))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.select("entry", "code", "term", weight.alias("weight"))


def stored_index(weighted: DataFrame, name: str, block: int = 262_144) -> LexicalIndex:
    """The index of that name in the shared folder, built the first time. The name says what it depends on (see scratch.stamp)."""
    return open_index(weighted.sparkSession, stored(weighted.sparkSession, name, lambda half: build_index(weighted, half, block)))


def match(queries: DataFrame, weighted: DataFrame | LexicalIndex, limit: int, weigh: str = "given", block: int = 262_144, prune: bool = True) -> DataFrame:
    """query, code, score, rank: products of weights summed per entry, the best entry per code; queries without a hit have no row.

    queries: query, terms (array, repeats allowed) and, where `weigh` is given, weights beside them. once: each distinct term
    weighs 1; root: the square root of its count in the query. The index is a stored one, or entry, code, term, weight rows of
    which one is built for this search. Without `prune` all postings are added up.
    """
    if weigh not in ("given", "once", "root"):
        raise ValueError(f"unknown weighing {weigh!r}")
    if isinstance(weighted, DataFrame):
        weighted = stored_index(weighted, f"lexical-{uuid.uuid4().hex}", block)
    return search(weighted, queries, limit, weigh, prune)


def query_terms(queries: DataFrame) -> DataFrame:
    """query, terms of queries(query, text), for match(weigh="once")."""
    return queries.select("query", tokens(F.col("text")).alias("terms"))


def sparse_terms(rows: DataFrame, key: str, weights: str) -> DataFrame:
    """query (the key), terms, weights from learned term weights in a map column, for match(weigh="given")."""
    return rows.select(F.col(key).alias("query"), F.map_keys(weights).alias("terms"), F.transform(F.map_values(weights), lambda x: x.cast("double")).alias("weights"))


def sparse_postings(rows: DataFrame, entry: str, code: str, weights: str) -> DataFrame:
    """entry, code, term, weight from learned term weights in a map column."""
    return rows.select(F.col(entry).alias("entry"), F.col(code).alias("code"), F.explode(weights).alias("term", "weight"))


def lexical_index(entries: DataFrame, weights: str | None = None) -> DataFrame:
    """entry, code, term, weight: learned weights where the encoder gives them (a map column), else BM25 over the text."""
    return sparse_postings(entries, "entry", "code", weights) if weights in entries.columns else bm25_weights(postings(entries))


def without_hits(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries that no entry shares a term with."""
    return queries.select("query").join(found.select("query").distinct(), "query", "left_anti")
