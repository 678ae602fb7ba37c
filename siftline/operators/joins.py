"""Lookup joins: the planner's choice by the stored size of the table, hot keys split at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows with a table that has one row per key.

    ``table`` should be stored (see ``materialize``): the planner then knows its size without a job, broadcasts it below the
    session's threshold, and shuffles both sides by key beyond it. Adaptive execution splits the partitions of the many rows that
    hold a hot key, by their real size, and repeats only those partitions of the table. Only joins that keep the left rows'
    identity are allowed, as only their left side can be split.
    """
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(f"lookup joins are left, inner, left_semi or left_anti, not {how}")
    return rows.join(table, list(keys), how)
