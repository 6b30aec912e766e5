"""The whole ranking plan: retrieve, restrict, fuse, boost, rerank, adjudicate. Every step is optional but the first three.

Inputs are relations; gold codes are not among them, so a ranking can't depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import fusion, prior, rerank, vectors
from rankloom.operators.lexical import lexical_index, match, query_terms, sparse_terms
from rankloom.operators.ranking import restrict
from rankloom.sources.session import safe_unions


@dataclass
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: {"knn": 1.0, "dense": 1.0, "lexical": 1.0})
    rrf_k: int = 60
    neighbours: int = 20
    top_k: int = 100
    candidates: int = 100
    prior_weight: float = 0.0
    rerank_mode: str | None = None
    rerank_weight: float = 1.0
    output: int = 50
    route_share: float = 0.0
    window: int = 20


@dataclass
class Inputs:
    """queries(record_id, text, vector), documents(id, vector), subjects(id, code), labels(id = code, vector), entries(entry, code, text), vocabulary(code).

    Where queries and entries have `weights` (a map of terms), they are matched by these instead of BM25. Ids and codes are of any type.
    """

    queries: DataFrame
    vocabulary: DataFrame
    documents: DataFrame | None = None
    subjects: DataFrame | None = None
    labels: DataFrame | None = None
    entries: DataFrame | None = None
    groups: DataFrame | None = None
    distribution: DataFrame | None = None
    model_scores: DataFrame | None = None
    answers: DataFrame | None = None


def retrieve(own: Inputs, s: Settings) -> DataFrame:
    """record_id, source, rank, code, score of every source with a weight; a record is no neighbour of itself."""
    asked, out = own.queries.select(F.col("record_id").alias("id"), "vector"), []
    if "knn" in s.weights:
        depth = max(s.top_k, s.neighbours)
        near = vectors.nearest(asked, own.documents, depth, exclude_self=True)
        known = own.subjects.join(own.vocabulary, "code", "left_semi")
        out.append(("knn", vectors.fill(near, known, s.neighbours, s.top_k)))
    if "dense" in s.weights:
        out.append(("dense", vectors.nearest(asked, own.labels, s.top_k).withColumnsRenamed({"id": "code", "sim": "score"})))
    if "lexical" in s.weights:
        sparse = "weights" in own.entries.columns and "weights" in own.queries.columns  # the encoder gives term weights
        words = sparse_terms(own.queries, "record_id", "weights") if sparse else query_terms(own.queries.select(F.col("record_id").alias("query"), "text"))
        out.append(("lexical", match(words, lexical_index(own.entries, "weights" if sparse else None), s.top_k, "given" if sparse else "once")))
    lists = [df.select(F.col("query").alias("record_id"), F.lit(name).alias("source"), "rank", "code", "score") for name, df in out]
    whole = lists[0]
    for df in lists[1:]:
        whole = whole.unionByName(df)
    return whole


def predict(own: Inputs, s: Settings) -> DataFrame:
    """record_id, rank, code, score."""
    safe_unions(own.queries.sparkSession)
    lists = restrict(retrieve(own, s), own.vocabulary, ["record_id", "source"])
    fused = fusion.combine(lists, s.weights, s.rrf_k, s.candidates).select("record_id", "rank", "code", "score")
    if own.distribution is not None and s.prior_weight:
        fused = prior.boost(fused, own.distribution, own.groups, s.prior_weight).select("record_id", "rank", "code", "score")
    ranked = fused
    if own.model_scores is not None and s.rerank_mode:
        ranked = rerank.rerank(fused, own.model_scores, s.rerank_mode, s.rerank_weight, s.rrf_k, s.candidates, s.output)
    if own.answers is not None and s.route_share:
        ranked = adjudicated(own, s, fused, ranked)
    return ranked.where(F.col("rank") < s.output)


def adjudicated(own: Inputs, s: Settings, fused: DataFrame, ranked: DataFrame) -> DataFrame:
    """Records are routed by the confidence of the fused list, even when it was reranked; refused answers change nothing."""
    routed = rerank.route(rerank.confidence(own.queries, fused), s.route_share)
    offered = ranked.where(F.col("rank") < s.window).groupBy("record_id").agg(F.collect_list(F.col("code").cast("string")).alias("codes"))
    read = own.answers.select("record_id", rerank.parse_response("response").alias("returned")).join(routed, "record_id", "left_semi").join(offered, "record_id")
    accepted = read.where(rerank.judge(F.col("codes"), F.col("returned")).isNull())
    kind = ranked.schema["code"].dataType
    chosen = accepted.select("record_id", F.posexplode(F.array_distinct("returned")).alias("at", "code")).withColumn("code", F.col("code").cast(kind))
    return rerank.apply_choices(ranked, chosen, s.window)
