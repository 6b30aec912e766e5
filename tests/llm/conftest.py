from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def clashing():
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "key", "bucket", "n", "p", "src", "rng", "fp", "component_id", "score", "row", "base", "around", "h", "ids", "kept", "rank")
    return lambda df: df.withColumns({c: F.lit(7) for c in names if c not in df.columns})
