"""Enrichment of security events with dimension tables, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import severity_score
from ..packs import dimensions, timeline, unified
from ..session import small_table
from .joins import lookup


def ip_reputation(spark: SparkSession) -> DataFrame:
    return small_table(
        spark,
        [(ip, kind, list(tags)) for ip, kind, tags in dimensions.IP_REPUTATION],
        "source_ip string, reputation string, tags array<string>",
    )


def windows_events(spark: SparkSession, name: str = "timeline") -> DataFrame:
    table = {"timeline": timeline, "unified": unified}[name].WINDOWS_EVENTS
    return small_table(
        spark,
        list(table), "event_id int, win_level string, win_type string, win_description string"
    )


def remediation(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(dimensions.REMEDIATION), "category string, advice string")


def with_reputation(events: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """Add reputation and tags of the source; a malicious source makes the event CRITICAL."""
    table = ip_reputation(events.sparkSession) if reputation is None else reputation
    return lookup(events, table, ["source_ip"]).withColumn(
        "threat_level",
        F.when(F.col("reputation") == "malicious", F.lit("CRITICAL")).otherwise(F.col("threat_level")),
    )


def with_remediation(events: DataFrame) -> DataFrame:
    """Fill the remediation text by category where a rule brings none."""
    table = remediation(events.sparkSession)
    own = F.nullif(F.col("remediation"), F.lit("")) if "remediation" in events.columns else F.lit(None)
    return (
        events.join(F.broadcast(table), "category", "left")
        .withColumn(
            "remediation", F.coalesce(own, F.col("advice"), F.lit(dimensions.REMEDIATION_DEFAULT))
        )
        .drop("advice")
    )


def with_windows_events(events: DataFrame, name: str = "timeline") -> DataFrame:
    """Let a known Windows event id decide type and level; a failed logon of level Error is HIGH.

    Expects event_id, win_log_level and the columns of first-match rules.
    """
    table = windows_events(events.sparkSession, name)
    known = F.col("win_type").isNotNull()
    raised = (F.col("event_id") == 4625) & (F.col("win_log_level") == "Error")
    return (
        events.join(F.broadcast(table), "event_id", "left")
        .withColumn("attack_type", F.when(known, F.col("win_type")).otherwise(F.col("attack_type")))
        .withColumn(
            "threat_level",
            F.when(known & raised, F.lit("HIGH")).when(known, F.col("win_level")).otherwise(F.col("threat_level")),
        )
        .withColumn("description", F.col("win_description"))
        .drop("win_type", "win_level", "win_description")
    )


def with_score(events: DataFrame) -> DataFrame:
    return events.withColumn("threat_score", severity_score(F.col("threat_level")))


def severe(level: Column) -> Column:
    """CRITICAL or HIGH."""
    return F.upper(level).isin("CRITICAL", "HIGH")


def ip_number(ip: Column) -> Column:
    """A dotted address as a number; null when it is not one."""
    parts = F.split(ip, r"\.")
    value = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    whole = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(whole, value[0] * 16777216 + value[1] * 65536 + value[2] * 256 + value[3])


def in_ranges(ip: Column, ranges=dimensions.PRIVATE_RANGES) -> Column:
    """The first listed range that contains the address, null when none does."""
    number, result = ip_number(ip), F.lit(None).cast("string")
    for cidr in reversed(ranges):
        base, bits = cidr.split("/")
        low = sum(int(part) << shift for part, shift in zip(base.split("."), (24, 16, 8, 0)))
        high = low + (1 << (32 - int(bits))) - 1
        result = F.when(number.between(low, high), F.lit(cidr)).otherwise(result)
    return result
