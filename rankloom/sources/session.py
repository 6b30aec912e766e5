"""Session settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def safe_unions(spark: SparkSession) -> None:
    """Let unions claim no partitioning of their own.

    Spark 4.1 may plan a join on a union's claimed partitioning and then, after re-planning at run time, find the union with
    another number of partitions ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
