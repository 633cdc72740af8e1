"""Names of the engine's queries, with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB twin, if there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from .plans import catalog, evaluation, graph, landed, pages, records, search, sessions, sync, text  # noqa: F401


_load()
