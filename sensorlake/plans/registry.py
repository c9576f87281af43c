"""Every registered query of the engine with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorlake.functions.numbers import steady_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = steady_sql(sql)
        return fn

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from sensorlake.plans import calibration, files, joins, names, packets, pixels, products, sources, stores, streams, windows  # noqa: F401
