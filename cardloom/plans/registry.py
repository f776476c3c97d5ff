"""All queries over the driver's tables, and their SQL: each module of queries adds its own."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    for area in ("catalog", "detection", "library", "profile", "source", "stream", "text", "vector", "view"):
        if importlib.util.find_spec(f"cardloom.plans.{area}_queries") is not None:
            importlib.import_module(f"cardloom.plans.{area}_queries")
