"""Text sources: lines with an explicit stream and a dense line number."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, text
from ..functions.evaluate import let, once
from ..operators.joins import lookup
from ..operators.sequences import chunk_of, dense_position
from ..session import materialize

LINE_CHUNK = 200_000


def with_line_numbers(scanned: DataFrame) -> DataFrame:
    """Add ``seq``, the 1-based line number inside the file.

    A file split is read by one task in order, so the row id minus the split's smallest row id is the
    position in the split; a table with one row per split holds how many lines come before it. The scanned lines are
    stored first: where splits begin depends on the number of cores at the time, so a second scan could cut files otherwise.
    """
    split = ["stream_id", "_block"]
    scanned = materialize(scanned, "scanned")
    counts = scanned.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        lookup(scanned, materialize(offsets, "splits"), split, "inner")
        .withColumn("seq", F.col("_offset") + F.col("_row") - F.col("_first") + 1)
        .drop("_block", "_row", "_first", "_offset")
    )


def _scan(spark: SparkSession, path: str | Sequence[str], glob: str | None, recursive: bool) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("stream_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def read_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    max_lines: int | None = None,
    skip_comments: bool = False,
    glob: str | None = None,
    recursive: bool = False,
    with_file_time: bool = False,
) -> DataFrame:
    """(stream_id, seq, raw) of text files: stripped, without blank lines and invalid bytes.

    ``seq`` is the line number in the file, counted before blank lines are dropped; so is ``max_lines``.
    """
    lines = with_line_numbers(_scan(spark, path, glob, recursive))
    if max_lines is not None:
        lines = lines.filter(F.col("seq") <= max_lines)
    lines = lines.withColumn("raw", text.strip(text.clean_utf8(F.col("value")))).filter(F.col("raw") != "")
    if skip_comments:
        lines = lines.filter(~F.col("raw").startswith("#"))
    return lines.select("stream_id", "seq", "raw", *(["file_time"] if with_file_time else []))


def read_directory(spark: SparkSession, path: str, **options) -> DataFrame:
    """All ``*.txt`` and ``*.log`` files of one folder."""
    return read_lines(spark, path, glob="*.{txt,log}", **options)


def read_tree(spark: SparkSession, path: str, recursive: bool = True, skip_comments: bool = True) -> DataFrame:
    """All ``*.log`` files below a folder; the path of a single file works as well."""
    glob = None if is_file(spark, path) else "*.log"
    return read_lines(spark, path, glob=glob, recursive=recursive, skip_comments=skip_comments)


def listed(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path) of the files that a scan would read, from the listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path")


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file and no folder, whatever its name looks like."""
    name = re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", path.rstrip("/"))
    return not listed(spark, path).filter(F.col("path").endswith(name)).isEmpty()


def first_paths(spark: SparkSession, path: str, glob: str, count: int | None) -> str | list[str]:
    """The first files of a tree in path order, chosen before anything is read; the tree itself without a count."""
    if count is None:
        return path
    return [r["path"] for r in listed(spark, path, glob, recursive=True).orderBy("path").limit(count).collect()]


def renumber(lines: DataFrame) -> DataFrame:
    """Dense ``seq`` again after lines were dropped, in the same order."""
    old = lines.withColumnRenamed("seq", "_line")
    return dense_position(old, ["stream_id"], ["_line"], chunk_of(F.col("_line"), LINE_CHUNK)).drop("_line")


def split_label(lines: DataFrame) -> DataFrame:
    """The first word as ``label`` and the rest as ``raw``; a line of one word has the label ``-``."""
    parts = F.split(F.col("raw"), r"\s+", 2)
    return lines.withColumns(
        {
            "label": F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.lit("-")),
            "raw": F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.col("raw")),
        }
    )


def read_labelled(spark: SparkSession, path: str, **options) -> DataFrame:
    return split_label(read_lines(spark, path, **options))


def pasted(df: DataFrame, column: str, stream: str) -> DataFrame:
    """Lines of a text column that holds many lines per row; blank ones are dropped, ``seq`` counts all."""
    return (
        df.select(F.col(stream).alias("stream_id"), F.posexplode(F.split(F.col(column), "\n")).alias("pos", "value"))
        .select("stream_id", (F.col("pos") + 1).cast("bigint").alias("seq"), text.strip(F.col("value")).alias("raw"))
        .filter(F.col("raw") != "")
    )


def head(lines: DataFrame, count: int) -> DataFrame:
    """The first lines of every stream, by line number."""
    return lines.filter(F.col("seq") <= count)


def tail(lines: DataFrame, count: int) -> DataFrame:
    """The last lines of every stream; only its length is aggregated, no stream is sorted."""
    lengths = materialize(lines.groupBy("stream_id").agg(F.max("seq").alias("_last")), "lengths")
    return lookup(lines, lengths, ["stream_id"], "inner").filter(F.col("seq") > F.col("_last") - count).drop("_last")


def first_files(lines: DataFrame, count: int) -> DataFrame:
    """Lines of the first files in path order."""
    files = lines.select("stream_id").distinct().orderBy("stream_id").limit(count)
    return lines.join(F.broadcast(files), "stream_id", "left_semi")


def positional_split(lines: DataFrame, share: float = 0.8) -> DataFrame:
    """Add ``part``: ``train`` for the first ``share`` of every stream, else ``test``."""
    lengths = materialize(lines.groupBy("stream_id").agg(F.max("seq").alias("_n")), "lengths")
    return (
        lookup(lines, lengths, ["stream_id"])
        .withColumn("part", F.when(F.col("seq") <= F.floor(F.col("_n") * share), "train").otherwise("test"))
        .drop("_n")
    )


def in_dates(lines: DataFrame, ts: Column, start: date | None, end: date | None) -> DataFrame:
    """Lines from ``start`` to ``end``, both days included; lines without a time are kept.

    The time is read once per line, where the lines were dealt to: as a filter it would be copied to the scan, once per comparison.
    """
    keep, time = F.lit(True), F.col("_time")
    if start:
        keep = keep & (time >= F.lit(start.isoformat()).cast("timestamp_ntz"))
    if end:
        keep = keep & (time < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return once(lines, "_time", ts).filter(time.isNull() | keep).drop("_time")


def linux_line_time(raw: Column, year: Column | int) -> Column:
    """The time a system log line starts with, in one of three layouts."""
    classic = formats.syslog_time(F.regexp_extract(raw, r"^([A-Z][a-z]{2}\s+\d+\s+\d+:\d+:\d+)", 1), year)
    iso = F.replace(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), F.lit("T"), F.lit(" "))
    return F.coalesce(classic, iso.try_cast("timestamp_ntz"))


def access_line_day(raw: Column) -> Column:
    """The day of an access line, from the text between the bracket and the first colon."""
    day = F.concat(F.regexp_extract(raw, r"\[([^:]+):", 1), F.lit(":00:00:00"))
    return let(day, formats.access_time)


def with_type(lines: DataFrame, unified: bool = False) -> DataFrame:
    """Add ``log_type`` per file: by its name, else by its first lines.

    Only the first 5 (or 10) lines of a file are looked at; the answer is one row per file.
    """
    name = F.regexp_extract("stream_id", r"([^/]+)$", 1)
    raw, low = F.col("raw"), F.lower("raw")
    early = lines.filter(F.col("seq") <= (10 if unified else 5))
    request = low.contains("get /") | low.contains("post /")
    if unified:
        tests = (
            ("linux", low.contains("sshd") | low.contains("sudo") | low.contains("dhclient")
             | low.contains("mysql") | low.contains("httpd")),
            ("tomcat", low.contains("catalina") | low.contains("localhost:")),
            ("windows", low.contains("eventid=")),
            ("nginx", request),
        )
        found = early.groupBy("stream_id").agg(*[F.bool_or(t).alias(n) for n, t in tests])
        hint = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n, _ in tests])
        fallback = "linux"
    else:
        line_hint = (
            F.when(raw.contains("EventID="), "windows")
            .when(raw.contains("INFO") & raw.contains("dfs."), "linux")
            .when(raw.contains("GET /") | raw.contains("POST /"), "nginx")
        )
        found = early.groupBy("stream_id").agg(
            F.min_by(line_hint, F.when(line_hint.isNotNull(), F.col("seq"))).alias("_hint")
        )
        hint, fallback = F.col("_hint"), "unknown"
    files = lines.select("stream_id").distinct().join(found, "stream_id", "left").select(
        "stream_id", F.coalesce(formats.file_type_by_name(name, unified), hint, F.lit(fallback)).alias("log_type")
    )
    return lookup(lines, materialize(files, "file-types"), ["stream_id"])


def read_auto(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """All ``.log`` and ``.txt`` files below a folder with their type; unknown files are left out."""
    lines = read_lines(spark, first_paths(spark, path, "*.{log,txt}", max_files), glob="*.{log,txt}", recursive=True)
    return with_type(lines).filter(F.col("log_type") != "unknown")


# Parts of a path that tell the type of its log.
PATH_TYPES = (
    ("windows", r"(?i)windows[^/]*/[^/]*$|/Windows_[^/]*\.log$"),
    ("linux", r"(?i)linux[^/]*/[^/]*$|/Linux_[^/]*\.log$"),
    ("apache", r"(?i)apache[^/]*/(.*/)?[^/]*$|/Apache_[^/]*\.log$"),
)


def path_type(path: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, pattern in reversed(PATH_TYPES):
        result = F.when(path.rlike(pattern), F.lit(name)).otherwise(result)
    return result


def balanced(lines: DataFrame, kind: str, per_kind: int | None = None, seed: int | None = None) -> DataFrame:
    """The first ``per_kind`` lines of every kind, in (stream, line) order; shuffled when a seed is given.

    The kinds are few and each may be huge: lines are numbered by chunks of a stream, so no task holds a whole kind.
    Without ``per_kind`` every kind gives as many lines as the smallest has.
    """
    known = lines.filter(F.col(kind).isNotNull())
    if per_kind is None:
        sizes = known.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
        per_kind = sizes.agg(F.coalesce(F.min("_n"), F.lit(0)).alias("n")).first()["n"]
    bucket = F.struct("stream_id", chunk_of(F.col("seq"), LINE_CHUNK).alias("chunk"))
    kept = dense_position(known, [kind], ["stream_id", "seq"], bucket, out="_r").filter(F.col("_r") <= per_kind).drop("_r")
    return kept if seed is None else kept.orderBy(F.rand(seed))


def read_balanced(spark: SparkSession, path: str, max_logs: int | None = None, seed: int = 0) -> DataFrame:
    """A shuffled sample with the same share of Windows, Linux and Apache lines, typed by path.

    ``max_logs`` bounds the lines of all kinds together; without it the smallest kind decides.
    """
    lines = read_lines(spark, path, glob="*.{txt,log}", recursive=True)
    return balanced(lines.withColumn("log_type", path_type(F.col("stream_id"))), "log_type", None if max_logs is None else max_logs // 3, seed)


def read_capped(spark: SparkSession, path: str, max_files: int | None = None, max_lines: int | None = None) -> DataFrame:
    """The first lines over the first files of a tree, in path and line order; all of them without bounds."""
    lines = read_lines(spark, first_paths(spark, path, "*.{txt,log}", max_files), glob="*.{txt,log}", recursive=True)
    lines = lines.orderBy("stream_id", "seq")
    return lines if max_lines is None else lines.limit(max_lines)


def fold_newlines(message: Column) -> Column:
    """Line breaks inside a message as blanks."""
    return F.regexp_replace(message, "\r?\n", " ")


def windows_line(ts: Column, level: Column, event_id: Column, message: Column) -> Column:
    """One Windows event in the line layout that the event parser reads."""
    return F.format_string("%s %s EventID=%d %s", ts, level, event_id, fold_newlines(message))
