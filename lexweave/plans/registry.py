"""Registry of the named queries and their equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL that checks it."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


MODULES = (
    "io", "filters", "joins", "aggregates", "windows", "sets", "scalars", "texts",
    "hypothesis", "graphs", "style", "links", "models", "ledgers",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
