"""Stateless rule matching, login alerts and running counters on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chains, match
from ..packs import dimensions


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of text files as they arrive: (stream_id, raw, file_time), stripped and without blank lines.

    A file source gives no line numbers; rules need none.
    """
    reader = spark.readStream
    for name, value in options.items():
        reader = reader.option(name, value)
    return (
        reader.text(path)
        .select(
            F.col("_metadata.file_path").alias("stream_id"),
            text.strip(text.clean_utf8(F.col("value"))).alias("raw"),
            F.col("_metadata.file_modification_time").alias("file_time"),
        )
        .filter(F.col("raw") != "")
    )


def stream_events(lines: DataFrame, rules: Sequence[match.Rule] | None = None) -> DataFrame:
    """Rule events of a stream; the same plan as for a batch."""
    return match.match_rules(lines, match.pack_v3() + match.pack_fields() if rules is None else rules)


def login_alerts(
    failures: DataFrame, late: str = "10 minutes", slide_minutes: int | None = None,
    threshold: int = dimensions.BRUTE_FORCE_FAILURES,
) -> DataFrame:
    """Brute-force windows of a stream of (ts, source_ip); lines later than ``late`` are dropped."""
    return chains.brute_force_alerts(failures.withWatermark("ts", late), threshold=threshold, slide_minutes=slide_minutes)


def login_sessions(failures: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Failures per source and session; a session ends after a quiet time of ``gap``."""
    return (
        failures.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "source_ip")
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "source_ip", "failures")
    )


def running_counts(events: DataFrame, columns: Sequence[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per time window and value of the given columns, for update mode."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), *columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *columns, "n")
    )


def line_sessions(lines: DataFrame, gap: str, late: str) -> DataFrame:
    """Lines per stream and session of a stream of (stream_id, seq, ts), each session as a row when it has closed.

    A session ends after a quiet time of ``gap``; it closes when the watermark, ``late`` behind the newest line, has passed its
    end. Lines that come later than that are dropped with the watermark.
    """
    return (
        lines.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "stream_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "stream_id", "lines", "first_seq", "last_seq")
    )
