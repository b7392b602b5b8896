"""All queries of the library outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import operator_queries, sql_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Query functions by name."""
    return sql_queries.queries() | operator_queries.QUERIES


def oracles() -> dict[str, str]:
    """Equivalent SQL by name, where there is one."""
    return sql_queries.oracles() | operator_queries.ORACLE
