"""Registry of queries and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame) -> DataFrame:
    """Round floating columns so two engines agree on the last digits."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float")
        else F.col(f"`{c}`")
        for c, t in df.dtypes])


def r(expr: str) -> str:
    """SQL text rounding a double the same way (and never returning a negative zero)."""
    return f"(round(cast({expr} as double), {DIGITS}) + 0.0::double)"
