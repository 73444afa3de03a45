"""Registry of the queries run on the supplied tables, each with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardflow.bindings.oracle import with_views
from wardflow.bindings.tables import Tables
from wardflow.session import with_compiled_methods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over ``Tables``; ``sql`` gives the same rows in SQL."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(with_compiled_methods(spark), folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
