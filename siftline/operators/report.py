"""Aggregates over the event table: counts, shares, risk, advice, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_rank, risk_events, risk_incidents, risk_unified, threat_score
from ..packs import dimensions
from ..session import small_table


def count_by(events: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Events per value of a column; null values do not count."""
    return events.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(out))


def top(counts: DataFrame, column: str, limit: int = 10, n: str = "n") -> DataFrame:
    """The most frequent values; ties in alphabetical order."""
    return counts.orderBy(F.desc(n), F.asc(column)).limit(limit)


def category_share(events: DataFrame, column: str = "category", limit: int = 10) -> DataFrame:
    """Rank, count and percentage of the top categories, the percentage being of all events."""
    counts = count_by(events, column)
    whole = counts.agg(F.sum("n").alias("_all"))
    best = top(counts, column, limit)
    # At most ``limit`` rows and one total: the window and the join below see nothing larger.
    return (
        best.join(F.broadcast(whole))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(column))).cast("bigint"))
        .select("rank", column, "n", F.round(F.col("n") * 100.0 / F.col("_all"), 1).alias("share"))
    )


def level_totals(events: DataFrame, level: str = "threat_level") -> DataFrame:
    """One row: total, critical, high, medium."""
    word = F.upper(F.col(level))
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(word == "CRITICAL").alias("critical"),
        F.count_if(word == "HIGH").alias("high"),
        F.count_if(word == "MEDIUM").alias("medium"),
    )


def risk_of_events(events: DataFrame) -> DataFrame:
    return level_totals(events).withColumn("risk_level", risk_events(F.col("critical"), F.col("high"), F.col("total")))


def risk_of_incidents(events: DataFrame) -> DataFrame:
    return level_totals(events).withColumn(
        "risk_level", risk_incidents(F.col("critical"), F.col("high"), F.col("medium"))
    )


def risk_of_both(events: DataFrame, files: DataFrame) -> DataFrame:
    """Risk over events and scanned files; only their level columns matter."""
    both = events.select("threat_level").unionByName(files.select("threat_level"))
    return level_totals(both).select(
        "critical", "high", risk_unified(F.col("critical"), F.col("high")).alias("risk_level")
    )


def score_of(events: DataFrame) -> DataFrame:
    """The 0–10 threat score with the counts it rests on."""
    return level_totals(events).withColumn(
        "threat_score", threat_score(F.col("critical"), F.col("high"), F.col("medium"), F.col("total"))
    )


def summary(events: DataFrame, rules: int = 0, severe_counts: bool = False) -> DataFrame:
    """Header of a report. ``severe_counts`` counts HIGH events as critical as well."""
    totals = level_totals(events)
    critical = F.col("critical") + F.col("high") if severe_counts else F.col("critical")
    return totals.select(
        F.col("total").alias("total_events"), critical.alias("critical_events"), F.col("high").alias("high_events"),
        F.lit(rules).cast("bigint").alias("rules_loaded"),
    )


def recommendations(counts: DataFrame, advice: Sequence[tuple], none_text: str | None = None) -> DataFrame:
    """Advice whose category count exceeds its threshold, with the count as finding.

    ``counts`` holds (category, n). The order of the advice is kept in ``ord``. ``none_text`` is the
    single row given when no advice applies.
    """
    spark = counts.sparkSession
    table = small_table(
        spark,
        [(i, *row) for i, row in enumerate(advice)],
        "ord int, category string, above int, severity string, recommendation string",
    )
    found = (
        counts.join(F.broadcast(table), "category")
        .filter(F.col("n") > F.col("above"))
        .select(
            "ord", "severity", "category", F.format_string("%d events of %s", "n", "category").alias("finding"),
            "recommendation",
        )
    )
    if none_text is None:
        return found
    some = found.agg(F.count(F.lit(1)).alias("_some"))
    otherwise = some.filter(F.col("_some") == 0).select(
        F.lit(0).alias("ord"), F.lit("INFO").alias("severity"), F.lit("").alias("category"),
        F.lit("").alias("finding"), F.lit(none_text).alias("recommendation"),
    )
    return found.unionByName(otherwise)


def critical_first(events: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    """Events by severity, most severe first, then by ``order``; optionally only the first ones."""
    ranked = events.withColumn("_rank", level_rank(F.col("threat_level"))).orderBy("_rank", *order)
    return (ranked if limit is None else ranked.limit(limit)).drop("_rank")


def timeline_head(events: DataFrame, limit: int = 100) -> DataFrame:
    """The first events by time with their ``position``; the limit is the report's own."""
    first = events.orderBy("ts", "stream_id", "timeline_order").limit(limit)
    place = F.row_number().over(Window.orderBy("ts", "stream_id", "timeline_order"))  # over the report's few rows
    return first.withColumn("position", place.cast("bigint"))


def first_types(events: DataFrame, column: str, position: Sequence[str], limit: int = 5) -> DataFrame:
    """The first distinct values of a column in order of first appearance."""
    return (
        events.groupBy(column)
        .agg(F.min(F.struct(*position)).alias("first_seen"))
        .orderBy("first_seen")
        .limit(limit)
        .select(column, *[F.col(f"first_seen.{p}").alias(p) for p in position])
    )


def file_counts(lines: DataFrame, kind: str = "log_type", file: str = "file_path") -> DataFrame:
    """Distinct files per log type."""
    return lines.groupBy(kind).agg(F.countDistinct(file).alias("files"))


ADVICE = {
    "events": (dimensions.ADVICE_EVENTS, dimensions.ADVICE_NONE["events"]),
    "incidents": (dimensions.ADVICE_INCIDENTS, dimensions.ADVICE_NONE["incidents"]),
    "timeline": (dimensions.ADVICE_TIMELINE, dimensions.ADVICE_NONE["timeline"]),
    "unified": (dimensions.ADVICE_UNIFIED, dimensions.ADVICE_NONE["unified"]),
}
