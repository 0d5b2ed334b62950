"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# In the order of the operators' numbers.
MODULES = [
    "line_dedup",
    "chat_format",
    "near_dedup",
    "language_id",
    "exact_dedup",
    "token_files",
    "decontamination",
    "packing",
    "licenses",
    "token_counts",
    "divergence",
    "merkle",
    "quality",
]


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"touchline.llm.{name}")
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)
