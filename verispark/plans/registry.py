"""Collects the queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, the independent text that must agree."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def r(value: str | Column, digits: int = 6) -> Column:
    """Rounded output column: engines differ in the last bits of a sum."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("bigint") for n in names})


def day_text(value: str | Column) -> Column:
    return F.date_format(F.col(value) if isinstance(value, str) else value, "yyyy-MM-dd")
