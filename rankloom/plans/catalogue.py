"""The registry of named queries: each with a Spark plan and, where SQL can say it, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name."""

    def put(plan: Plan) -> Plan:
        PLANS[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def text(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")
