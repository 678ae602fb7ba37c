"""Threat levels: words, scores, labels and overall risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level scores and their order (0 is the most severe).
SCORES = {"CRITICAL": 10.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "INFO": 1.0}
RANKS = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def _lookup(word: Column, table: dict, default) -> Column:
    result = None
    for key, value in table.items():
        test = F.upper(word) == key
        result = F.when(test, F.lit(value)) if result is None else result.when(test, F.lit(value))
    return result.otherwise(F.lit(default))


def severity_score(word: Column) -> Column:
    """Score of a severity word in any case; unknown words count as medium."""
    return _lookup(word, SCORES, SCORES["MEDIUM"])


def level_rank(word: Column) -> Column:
    """0 for the most severe level; unknown words come last."""
    return _lookup(word, RANKS, len(RANKS))


def score_label(score: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW by score; everything below medium is LOW."""
    return F.when(score >= 10, "CRITICAL").when(score >= 7.5, "HIGH").when(score >= 5, "MEDIUM").otherwise("LOW")


def risk_events(critical: Column, high: Column, total: Column) -> Column:
    """Risk of a rule analysis."""
    return (
        F.when(critical > 0, "CRITICAL").when(high > 10, "HIGH").when(total > 0, "MEDIUM").otherwise("SAFE")
    )


def risk_incidents(critical: Column, high: Column, medium: Column) -> Column:
    """Risk of an incident analysis."""
    return (
        F.when((critical > 0) | (high > 10), "CRITICAL")
        .when((high > 0) | (medium > 20), "HIGH")
        .when(medium > 0, "MEDIUM")
        .otherwise("INFO")
    )


def risk_unified(critical: Column, high: Column) -> Column:
    """Risk over log lines and scanned files together."""
    return F.when(critical > 0, "VERY_HIGH").when(high > 5, "HIGH").when(high > 0, "MEDIUM").otherwise("LOW")


def threat_score(critical: Column, high: Column, medium: Column, total: Column) -> Column:
    """0 to 10 from weighted counts per hundred events, one decimal."""
    weighted = critical * 3 + high * 1.5 + medium * 0.5
    return F.round(F.least(F.lit(10.0), weighted / F.greatest(F.lit(1.0), total / 100)), 1)
