"""Evaluation against known truth, and summaries of a detection run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import count_by, top


def with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results next to the truth of the same line."""
    return results.join(truth, ["stream_id", "seq"])


def confusion(judged: DataFrame, by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Counts tp, fp, tn, fn of (is_anomaly, actual); ``rollup`` adds the overall row."""
    grouped = judged.rollup(*by) if rollup else judged.groupBy(*by)
    flagged, actual = F.col("is_anomaly"), F.col("actual")
    return grouped.agg(
        F.count_if(flagged & actual).alias("tp"),
        F.count_if(flagged & ~actual).alias("fp"),
        F.count_if(~flagged & ~actual).alias("tn"),
        F.count_if(~flagged & actual).alias("fn"),
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, f_measure and accuracy from confusion counts; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn(
            "f_measure", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
        .withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
    )


def compare_methods(judged: DataFrame) -> DataFrame:
    """Metrics per method and over all methods; the overall row is named ``overall``."""
    named = judged.withColumn("method", F.coalesce("method", F.lit("unnamed")))
    return metrics(confusion(named, ["method"], rollup=True)).withColumn(
        "method", F.coalesce("method", F.lit("overall"))
    )


def anomaly_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines, anomalies, normal lines and the anomaly rate in percent."""
    return (
        results.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"))
        .withColumn("normals", F.col("total") - F.col("anomalies"))
        .withColumn("rate", ratio(F.col("anomalies") * 100.0, F.col("total")))
    )


def detection_by_label(results: DataFrame) -> DataFrame:
    """Detection rate on anomalous lines and accuracy on normal lines (label ``-``)."""
    normal = F.col("label") == "-"
    rows = results.groupBy(normal.alias("is_normal")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("flagged")
    )
    right = F.when(F.col("is_normal"), F.col("total") - F.col("flagged")).otherwise(F.col("flagged"))
    return rows.withColumn("correct", right).withColumn("rate", ratio(right * 100.0, F.col("total")))


def type_counts(results: DataFrame) -> DataFrame:
    """Anomalies per type."""
    return count_by(results.filter("is_anomaly"), "anomaly_type")


def path_counters(results: DataFrame) -> DataFrame:
    """Path anomalies: total, with unseen template, without predictions, and both as shares."""
    counts = results.filter(F.col("anomaly_type") == "path").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("in_vocab")).alias("unseen"),
        F.count_if(F.coalesce(F.size("predictions"), F.lit(0)) <= 0).alias("without_predictions"),
    )
    return counts.withColumns(
        {
            "unseen_share": ratio(F.col("unseen") * 100.0, F.col("total")),
            "without_share": ratio(F.col("without_predictions") * 100.0, F.col("total")),
        }
    )


def top_keys(results: DataFrame, limit: int = 30) -> DataFrame:
    """The templates with most path anomalies, and whether the vocabulary lacks them."""
    counts = (
        results.filter(F.col("anomaly_type") == "path")
        .groupBy("log_key")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("in_vocab")).alias("unseen"))
    )
    return top(counts, "log_key", limit)


def context_signature(predictions: Column) -> Column:
    """The three most likely next templates as one text."""
    keys = F.transform(F.slice(predictions, 1, 3), lambda p: p["key"])
    return F.when(F.coalesce(F.size(predictions), F.lit(0)) <= 0, F.lit("<no-predictions>")).otherwise(
        F.concat_ws(" | ", keys)
    )


def top_contexts(results: DataFrame, limit: int = 30) -> DataFrame:
    """The prediction contexts with most path anomalies."""
    signed = results.filter(F.col("anomaly_type") == "path").select(
        context_signature(F.col("predictions")).alias("context")
    )
    return top(count_by(signed, "context"), "context", limit)


def verdict(accuracy_percent: Column) -> Column:
    """EXCELLENT from 80, GOOD from 70, FAIR from 60, else NEEDS_IMPROVEMENT."""
    return (
        F.when(accuracy_percent >= 80, "EXCELLENT")
        .when(accuracy_percent >= 70, "GOOD")
        .when(accuracy_percent >= 60, "FAIR")
        .otherwise("NEEDS_IMPROVEMENT")
    )
