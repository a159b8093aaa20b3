"""Registered queries and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import R, bind, spread, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

__all__ = ["QUERIES", "SQL", "query", "load", "bind", "with_", "R", "spread"]


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key`` with its checking SQL."""
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


def load() -> None:
    """Import every module of the catalog once."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
