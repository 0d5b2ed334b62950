"""Registered queries by survey id."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "temporal_queries",
    "contextual_queries",
    "advanced_queries",
    "page_queries",
    "layout_queries",
    "loader_queries",
    "name_queries",
    "model_queries",
]


def all_queries():
    for name in MODULES:
        import_module(f"touchline.plans.{name}")
    from touchline.plans.registry import QUERIES
    return dict(QUERIES)


def all_oracles():
    all_queries()
    from touchline.plans.registry import ORACLES
    return dict(ORACLES)
