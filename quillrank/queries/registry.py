"""Named queries over the test tables, each with its check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrank.plans.fixtures import check_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` may name derived views in braces."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            CHECKS[function.__name__] = check_sql(sql)
        return function

    return register
