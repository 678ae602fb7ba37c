"""Attack chains per source, and brute-force alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..packs import dimensions
from .sequences import dense_position


def stage_of(category: Column) -> Column:
    """Stage of an attack chain, null for categories that are no stage."""
    result = F.lit(None).cast("string")
    for name, stage in dimensions.CHAIN_STAGES:
        result = F.when(category == name, F.lit(stage)).otherwise(result)
    return result


def attack_chains(events: DataFrame, order: Sequence[str] = ("seq",), min_stages: int = 2) -> DataFrame:
    """One row per source with at least two stage events; any exfiltration makes it CRITICAL.

    Only sums, minima and flags are kept per source, so a source with a third of all events is merged on
    the map side like any other. The stage events themselves are in ``chain_stages``.
    """
    staged = events.withColumn("stage", stage_of(F.col("category"))).filter(
        F.col("stage").isNotNull() & F.col("source_ip").isNotNull()
    )
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = {
        stage: F.min(F.when(F.col("stage") == stage, position)).alias(f"_first_{stage}")
        for stage in dict.fromkeys(s for _, s in dimensions.CHAIN_STAGES)
    }
    counts = [F.count_if(F.col("stage") == s).alias(s) for s in first]
    rows = (
        staged.groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("n_stages"), *counts, *first.values())
        .filter(F.col("n_stages") >= min_stages)
    )
    appeared = F.array_sort(
        F.array_compact(
            F.array(*[
                F.when(F.col(f"_first_{s}").isNotNull(), F.struct(F.col(f"_first_{s}").alias("at"), F.lit(s).alias("stage")))
                for s in first
            ])
        )
    )
    return rows.select(
        F.concat(F.lit("CHAIN_"), F.replace("source_ip", F.lit("."), F.lit(""))).alias("chain_id"),
        "source_ip",
        F.when(F.col("exfiltration") > 0, "CRITICAL").otherwise("MEDIUM").alias("threat_level"),
        "n_stages",
        *first,
        F.transform(appeared, lambda s: s["stage"]).alias("stages_in_order"),
    )


def chain_stages(
    events: DataFrame, order: Sequence[str] = ("seq",), bucket: Column | None = None, min_stages: int = 2
) -> DataFrame:
    """Every stage event of every chain with its number inside the chain, one row each.

    The list is not collected: a chain may have any number of stages. ``bucket`` grows with ``order`` and
    bounds how many events of one source a task numbers (see ``dense_position``).
    """
    staged = events.withColumn("stage", stage_of(F.col("category"))).filter(
        F.col("stage").isNotNull() & F.col("source_ip").isNotNull()
    )
    numbered = dense_position(
        staged, ["source_ip"], order, F.lit(0) if bucket is None else bucket, "stage_no", total="n_stages"
    )
    return numbered.filter(F.col("n_stages") >= min_stages)


def brute_force_alerts(
    failures: DataFrame,
    minutes: int = dimensions.BRUTE_FORCE_MINUTES,
    threshold: int = dimensions.BRUTE_FORCE_FAILURES,
    lockout: int = dimensions.BRUTE_FORCE_LOCKOUT,
    slide_minutes: int | None = None,
) -> DataFrame:
    """Windows in which a source fails to log in at least ``threshold`` times.

    Works on a batch and on a stream with a watermark on ``ts`` alike.
    """
    size = f"{minutes} minutes"
    window = F.window("ts", size, f"{slide_minutes} minutes" if slide_minutes else size)
    return (
        failures.groupBy(window.alias("w"), "source_ip")
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= threshold)
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source_ip", "failures",
            (F.col("failures") >= lockout).alias("lockout"),
        )
    )
