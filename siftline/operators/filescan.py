"""Web-shell scanners over whole file contents: (path, content) -> findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..packs import files as pack
from .match import hits, ignoring_case


def extension(path: Column) -> Column:
    """Lower-case extension of the file name without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def with_extension(files: DataFrame, extensions) -> DataFrame:
    """Files with one of the extensions (written with a dot)."""
    return files.filter(extension(F.col("path")).isin([e.lstrip(".") for e in extensions]))


def scan_first_hit(files: DataFrame) -> DataFrame:
    """Files with at least one hit: the first rule that hits, its confidence, level, size and md5."""
    low = files.withColumn("_low", F.lower("content"))
    found = F.coalesce(
        *[
            F.when(
                hits(F.col("content"), F.col("_low"), p),
                F.struct(F.lit(name).alias("pattern"), F.lit(conf).alias("confidence")),
            )
            for name, conf, p in pack.FIRST_HIT
        ]
    )
    return (
        low.withColumn("_hit", found)
        .filter(F.col("_hit").isNotNull())
        .select(
            "path", "_hit.pattern", "_hit.confidence",
            F.length("content").cast("bigint").alias("file_size"),
            F.md5(F.col("content").cast("binary")).alias("file_hash"),
            F.when(F.col("_hit.confidence") >= pack.HIGH_CONFIDENCE, "HIGH").otherwise("MEDIUM").alias("threat_level"),
        )
    )


def scan_by_score(files: DataFrame) -> DataFrame:
    """Every file with language, highest weight, level, verdict and the names of all rules that hit."""
    language = F.lit("php")
    for ext, name in pack.LANGUAGE_OF.items():
        language = F.when(extension(F.col("path")) == ext, F.lit(name)).otherwise(language)
    low = files.withColumn("_low", F.lower("content")).withColumn("language", language)
    content, lowered = F.col("content"), F.col("_low")
    tests = [
        (name, weight, (F.col("language") == lang) & hits(content, lowered, p))
        for lang, rules in pack.BY_LANGUAGE.items()
        for name, weight, p in rules
    ]
    tests += [(f"tool {name}", weight, lowered.contains(name)) for name, weight in pack.TOOLS]
    name, weight, p = pack.ENCODED
    tests.append((name, weight, content.rlike(ignoring_case(p).replace("(?iU)", "(?U)"))))
    found = F.array_compact(
        F.array(*[F.when(t, F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, t in tests])
    )
    score = F.coalesce(F.array_max(F.transform("_found", lambda x: x["weight"])), F.lit(0.0))
    level = F.lit("INFO")
    for bound, label in reversed(pack.BOUNDS):
        level = F.when(F.col("confidence") >= bound, F.lit(label)).otherwise(level)
    return (
        low.withColumn("_found", found)
        .withColumn("confidence", score)
        .select(
            "path", "language", "confidence",
            level.alias("threat_level"),
            (F.col("confidence") >= pack.SUSPICIOUS).alias("is_webshell"),
            F.transform("_found", lambda x: x["name"]).alias("matched"),
            F.length("content").cast("bigint").alias("file_size"),
            F.md5(F.col("content").cast("binary")).alias("file_hash"),
        )
    )


def scan_stats(results: DataFrame) -> DataFrame:
    """One row: files, suspicious files, and files per level."""
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("is_webshell").alias("webshell_count"),
        *[F.count_if(F.col("threat_level") == lv).alias(lv.lower()) for lv in levels],
    )


def critical_files(results: DataFrame) -> DataFrame:
    """Suspicious files of level CRITICAL or HIGH."""
    return results.filter(F.col("is_webshell") & F.col("threat_level").isin("CRITICAL", "HIGH"))
