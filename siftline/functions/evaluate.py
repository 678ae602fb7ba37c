"""Evaluate a costly expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column, drop_nulls: bool = False) -> DataFrame:
    """Add a column that later projections and filters read instead of repeating its expression.

    The optimizer merges neighbouring projections and pushes filters down by copying expressions, which
    is wrong for a chain of patterns. A generated one-element array stays where it is.
    """
    array = F.array(value)
    return df.withColumn(name, F.explode(F.array_compact(array) if drop_nulls else array))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
