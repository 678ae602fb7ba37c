"""Whole files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_files(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """(path, content) of every file below a folder with one of the extensions."""
    names = ",".join(e.lstrip(".") for e in extensions)
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{names}}}")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), text.clean_utf8(F.col("value")).alias("content"))
    )
