"""The registered queries: name -> callable, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.store import STORE_SQL, opened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, store: bool = True, recursive: bool = False):
    """Register a function of (store, spark, sf_dir), or of (spark, sf_dir) without a store."""

    def add(f):
        QUERIES[name] = (lambda spark, d: f(opened(spark, d), spark, d)) if store else f
        if sql:
            SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{STORE_SQL} {sql}" if store else sql).strip()
        return f

    return add
