"""Order-aware building blocks that never put a whole stream into one task.

A stream (a file, a host, a user) may hold a third of all lines. Every operator here therefore works on
*chunks* of a stream: positions come from per-bucket counts plus running offsets, and windows that look a
bounded distance back or ahead run per chunk, with the few rows near a chunk border copied to the
neighbour. Results equal those of a window over the whole stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

CHUNK_ROWS = 200_000


def chunk_of(position: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """The chunk that a 1-based position falls in."""
    return F.floor((position - 1) / F.lit(chunk_rows)).cast("bigint")


def dense_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    out: str = "seq",
    total: str | None = None,
) -> DataFrame:
    """Number rows 1..n inside each group.

    ``bucket`` must grow with ``order`` (for example the hour of the timestamp, or a chunk number); rows are
    numbered inside (group, bucket) and shifted by the running count of earlier buckets, so one task holds
    one bucket, never a whole group. ``total`` optionally names a column for the group's row count.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*group).orderBy("_bucket")
    offsets = counts.select(
        *keys,
        F.coalesce(
            F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = (
        rows.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.col("_local"))
    )
    if total:
        numbered = numbered.withColumnRenamed("_total", total)
    return numbered.drop("_bucket", "_local", "_offset", "_total")


def range_position(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Number all rows from 0 by ``order``, whatever their values have in common.

    Rows are dealt by ranges of ``order`` and sorted inside them; a row's number is its place inside the range plus the sizes
    of the ranges before, of which there are as many as shuffle partitions. The dealt rows are stored, so the ranges stay.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(shifts, "_range").withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def windowed(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``position`` must be dense and 1-based inside the group. Each function receives the ordered window of
    one chunk, which already contains the border rows of the neighbours.
    """
    chunk_rows = max(chunk_rows, back, ahead, 1)
    inside = F.pmod(F.col(position) - 1, F.lit(chunk_rows))
    targets = F.concat(
        F.array(F.col("_home")),
        F.when(inside >= chunk_rows - back, F.array(F.col("_home") + 1)).otherwise(F.array().cast("array<bigint>")),
        F.when((inside < ahead) & (F.col("_home") > 0), F.array(F.col("_home") - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    spec = Window.partitionBy(*group, "_chunk").orderBy(position)
    return (
        df.withColumn("_home", chunk_of(F.col(position), chunk_rows))
        .withColumn("_chunk", F.explode(targets))
        .withColumns({name: make(spec) for name, make in columns.items()})
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_home", "_chunk")
    )


def previous(column: str, count: int) -> Callable[[WindowSpec], Column]:
    """The ``count`` values before the current row, oldest first; nulls where there are none."""
    return lambda spec: F.array(*[F.lag(column, i).over(spec) for i in range(count, 0, -1)])


def last_known(
    df: DataFrame, group: Sequence[str], position: str, value: str, out: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The last non-null value before each row, however far back it is.

    Inside a chunk a window finds it; across chunks a small table with one row per chunk carries it on.
    """
    keys = [*group, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(position), chunk_rows))
    ends = rows.groupBy(*keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end")
    )
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, keys)
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_inside", "_carried")
    )


def running_sum(
    df: DataFrame, group: Sequence[str], position: str, value: Column, out: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Running sum up to and including each row, from chunk totals plus a sum inside the chunk."""
    keys = [*group, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(position), chunk_rows)).withColumn("_value", value)
    totals = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_chunk", "_value", "_inside", "_offset")
    )


def lowest_before(
    df: DataFrame, group: Sequence[str], position: str, value: str, out: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The smallest value over all earlier rows of the group, null for the first row."""
    keys = [*group, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(F.col(position), chunk_rows))
    lows = rows.groupBy(*keys).agg(F.min(value).alias("_low"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lows.select(*keys, F.min("_low").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.min(value).over(inside))
        .join(carried, keys)
        .withColumn(out, F.least("_inside", "_carried"))
        .drop("_chunk", "_inside", "_carried")
    )
