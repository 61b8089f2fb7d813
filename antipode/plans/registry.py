"""Names, builders and SQL of the registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ("pair_queries", "stat_queries", "rule_queries", "search_queries", "graph_queries",
           "model_queries", "forest_queries", "store_queries")


def query(name: str, sql: str | None = None):
    """Register a builder under ``name`` with its SQL."""
    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql.strip()
        return build
    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"antipode.plans.{module}")
