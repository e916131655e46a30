"""The registry: named queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded, with negative zero cleared, under the column's own name if it has one."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(column) if isinstance(column, str) else out
