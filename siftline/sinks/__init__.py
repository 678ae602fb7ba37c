"""Sinks: reports, timelines, anomaly lists and exports, written by Spark tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_rank


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def nested_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON text from several small report tables, each an array under its name.

    Report tables are top lists and totals, bounded by their limits; event tables do not belong here.
    """
    result = None
    for name, part in parts.items():
        row = F.struct(*part.columns)
        folded = part.agg(F.to_json(F.collect_list(row)).alias(name))
        result = folded if result is None else result.join(F.broadcast(folded))
    pieces = [
        F.concat(F.lit(f'"{name}":'), F.col(name)) for name in parts
    ]
    return result.select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("value"))


def anomaly_lines(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Text report lines of the first anomalies in stream and line order."""
    rows = results.filter("is_anomaly").orderBy("stream_id", "seq")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(
        F.format_string("%s line %d [%s] %s", F.col("stream_id").cast("string"), "seq", "anomaly_type", "raw").alias("value")
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """Header lines of a text report from a one-row summary table."""
    pairs = F.array(*[
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns
    ])
    return summary.select(F.explode(pairs).alias("value"))


def timeline_lines(events: DataFrame) -> Column:
    """The text of one timeline row."""
    return F.format_string(
        "%s [%s] %s %s %s", F.coalesce(F.col("ts").cast("string"), F.lit("-")), "threat_level", "attack_type",
        F.coalesce("source_ip", F.lit("-")), "raw",
    )


def write_timeline(events: DataFrame, path: str) -> None:
    """All events by time, one text line each; the sort is by range, so many tasks write it."""
    ordered = events.orderBy("ts", "stream_id", "timeline_order")
    ordered.select(timeline_lines(events).alias("value")).write.mode("overwrite").text(path)


def write_timeline_report(events: DataFrame, counts: dict[str, DataFrame], advice: DataFrame, path: str) -> None:
    """Timeline report: the counts, the advice and all lines, in folders below ``path``."""
    for name, table in counts.items():
        summary_rows = table.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in table.columns]).alias("value"))
        summary_rows.write.mode("overwrite").text(f"{path}/{name}")
    advice.orderBy("ord").select(
        F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("recommendation")).alias("value")
    ).write.mode("overwrite").text(f"{path}/advice")
    write_timeline(events, f"{path}/timeline")


def write_outcomes(results: DataFrame, path: str) -> None:
    """Labelled results in one folder per outcome: detected, missed, false_alarm, quiet."""
    anomalous = F.col("label") != "-"
    outcome = (
        F.when(anomalous & F.col("is_anomaly"), "detected").when(anomalous, "missed")
        .when(F.col("is_anomaly"), "false_alarm").otherwise("quiet")
    )
    results.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").json(path)


def write_scan_summary(counters: DataFrame, keys: DataFrame, contexts: DataFrame, samples: DataFrame, path: str) -> None:
    """Counters, top templates, top contexts and sample lines of a scan, one folder each."""
    summary_lines(counters).write.mode("overwrite").text(f"{path}/counters")
    keys.select(
        F.concat(F.col("n").cast("string"), F.lit("\t"), F.col("log_key"), F.when(F.col("unseen"), " (unseen)").otherwise(""))
        .alias("value")
    ).write.mode("overwrite").text(f"{path}/log_keys")
    contexts.select(F.concat(F.col("n").cast("string"), F.lit("\t"), F.col("context")).alias("value")).write.mode(
        "overwrite"
    ).text(f"{path}/contexts")
    samples.write.mode("overwrite").text(f"{path}/samples")


def export_lines(lines: DataFrame, path: str) -> None:
    """Raw lines as UTF-8 text, in line order within every stream."""
    lines.repartitionByRange("stream_id", "seq").sortWithinPartitions("stream_id", "seq").select(
        F.col("raw").alias("value")
    ).write.mode("overwrite").text(path)


def severe_first(events: DataFrame) -> DataFrame:
    return events.orderBy(level_rank(F.col("threat_level")), "ts")
