"""Registered queries: each operator on the given tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragtables.catalog.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the tables and the views of :mod:`ragtables.catalog.fixtures`."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from ragtables.catalog import conversations, integrity, retrieval, snapshots, sources, text, training, weighting  # noqa: F401
