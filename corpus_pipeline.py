"""A training corpus from documents: drop bad text, exact copies and near copies, mix the sources, encode.

Each stage reads what its predecessor wrote. The first four return documents with their columns; the last returns a row per
document of the mix (as often as it is taken): doc_id, n_tokens, and digests of its ids and of the text they decode to.

Cases: null text is empty everywhere, and so are texts without words: quality scores them, one of them stays in exact_dedup,
and the mix takes them with the epochs of their source. Ids may be null or repeat: rows are told apart by id and text.
Of equal texts the largest id stays, of near copies the smallest. An empty table stays empty. Extra columns are carried to
the mix with their values, whatever their names. Long texts are read whole by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.bpe import encode_decode, token_digests
from rankloom.llm.exact_dedup import drop_exact_copies
from rankloom.llm.mixing import mixed_documents
from rankloom.llm.near_copies import drop_near_duplicates
from rankloom.llm.quality import score_quality, train_quality
from rankloom.llm.shared import columns, forget, free_name, materialise, remainder, scratch_kept_to, table
from rankloom.sources.session import safe_unions


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that op3 may learn from."""
    labels, score = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1), free_name(docs, "score")
    return score_quality(docs, train_quality(docs, labels), docs.columns, score_col=score).where(F.col(score) >= 0.5).select(*columns(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe_unions(spark)
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe_unions(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("mix", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_kept_to(spark) as kept:
            done = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(done)
        if name != STAGES[0][0]:
            forget(docs)  # the next stage has been written
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no quadratic discriminant trained on the fly, no SimHash and no BPE: tests/llm holds run() against plain Python.
ORACLE_SQL = None
