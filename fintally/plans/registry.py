"""Registry of named queries (Spark callables) and their DuckDB oracle statements."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fintally.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
ORACLE_BODY: dict[str, str] = {}  # without the views, to build other statements from


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
            ORACLE_BODY[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from fintally.plans import (  # noqa: F401
        q_analytics,
        q_ledger,
        q_detect,
        q_changes,
        q_similarity,
        q_import,
        q_extra,
    )
