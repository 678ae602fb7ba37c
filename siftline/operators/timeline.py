"""Timelines: typed parse, first-match rules, event-id override, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.evaluate import once
from .events import with_windows_events
from .match import first_match, first_match_pack

LOG_TYPES = ("linux", "windows", "tomcat", "nginx")


def parsed_columns(raw: Column, log_type: str, year: Column | int, iso_fallback: bool = True) -> Column:
    """One common struct for every log type; null when the line has another layout."""
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("int")

    def common(p: Column, **parts: Column) -> Column:
        names = {"host": text, "path": text, "ip": text, "message": text, "level": text, "event_id": number,
                 "method": text, "status": number, "user_agent": text, "thread": text} | parts
        return F.when(
            p.isNotNull(), F.struct(p["ts"].alias("ts"), *[c.alias(n) for n, c in names.items()])
        )

    if log_type == "linux":
        p = formats.parse_syslog(raw, year, iso_fallback)
        return common(p, host=p["host"], message=p["message"])
    if log_type == "windows":
        p = formats.parse_windows(raw)
        return common(p, level=p["level"], event_id=p["event_id"], message=p["message"])
    if log_type == "tomcat":
        p = formats.parse_tomcat(raw)
        return common(p, thread=p["thread"], level=p["level"], message=p["message"])
    if log_type == "nginx":
        p = formats.parse_access(raw)
        return common(
            p, ip=p["ip"], path=p["path"], method=p["method"], status=p["status"], user_agent=p["user_agent"]
        )
    raise ValueError(f"unknown log type {log_type}")


def timeline_events(
    lines: DataFrame, log_type: str, year: Column | int | None = None, pack: str = "timeline", order: str = "seq"
) -> DataFrame:
    """Every line of the given type as an event; lines with another layout are dropped.

    A syslog line has no year: without ``year`` it is the one in which the file was written (``file_time``, see read_lines), and 1970 for
    lines that don't come from files.

    A line without a rule hit is an INFO event of type unknown. ``timeline_order`` keeps the line order.
    """
    if year is None:
        year = F.coalesce(F.year("file_time"), F.lit(1970)) if "file_time" in lines.columns else 1970
    parsed = once(
        lines, "_p", parsed_columns(F.col("raw"), log_type, year, pack == "timeline"), drop_nulls=True
    )
    flat = parsed.withColumns(
        {
            "ts": F.col("_p.ts"),
            "source_ip": formats.source_ip(F.col("raw"), F.col("_p.ip")),
            "target": F.coalesce(F.nullif(F.col("_p.host"), F.lit("")), F.col("_p.path"), F.lit("")),
            "event_id": F.col("_p.event_id"),
            "win_log_level": F.col("_p.level"),
            "event_type": F.lit(log_type),
        }
    )
    found = first_match(flat, first_match_pack(pack))
    if log_type == "windows":
        found = with_windows_events(found, pack)
    else:
        found = found.withColumn("description", F.lit(None).cast("string"))
    details = F.map_filter(
        F.create_map(
            *[
                part
                for name, value in (
                    ("hostname", F.col("_p.host")), ("path", F.col("_p.path")), ("message", F.col("_p.message")),
                    ("level", F.col("_p.level")), ("event_id", F.col("_p.event_id").cast("string")),
                    ("method", F.col("_p.method")), ("status", F.col("_p.status").cast("string")),
                    ("user_agent", F.col("_p.user_agent")), ("thread", F.col("_p.thread")),
                    ("matched_pattern", F.col("matched_pattern")), ("captured", F.array_join("captured", "|")),
                    ("description", F.col("description")),
                )
                for part in (F.lit(name), value)
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    return (
        found.withColumn("details", details)
        .withColumn("attack_type", F.coalesce("attack_type", F.lit("unknown")))
        .withColumn("threat_level", F.coalesce("threat_level", F.lit("INFO")))
        .withColumn("timeline_order", F.col(order))
        .drop("_p")
    )


def sorted_timeline(events: DataFrame) -> DataFrame:
    """Events by time, then line order. Needed for a written timeline only, never for statistics."""
    return events.orderBy("ts", "stream_id", "timeline_order")
