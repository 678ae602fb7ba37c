"""Named queries over the given tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .views import sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, uses: Sequence[str] = (), sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; ``uses`` names the SQL steps that ``sql`` reads."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql_with(uses, sql)
        return function

    return register
