"""Parameter models: per template, the expected next parameter vector and an error threshold.

The model is one regression per (template, position) from the last values to the next one, on normalised
values: a line from one value back (``train``), or from as many as wanted (``train_lags``). All of its parts are sums, so training needs no task that sees a whole template.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import lookup
from .sequences import CHUNK_ROWS, chunk_of, dense_position, previous, windowed

# Clipping in standard deviations, bound after scaling, threshold width, held-out share.
CLIP_SIGMA = 3.0
CLIP_SCALED = 5.0
THRESHOLD_SIGMA = 2.0
HELD_OUT = 0.1


def normalize(df: DataFrame, column: str, out: str, mean: float | None = None, std: float | None = None) -> DataFrame:
    """Scale a column by the given or computed mean and population deviation; a zero deviation counts as 1."""
    if mean is not None and std is not None:
        return df.withColumn(out, (F.col(column) - F.lit(mean)) / F.lit(1.0 if std == 0 else std))
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    scale = F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std"))
    return (
        df.join(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("_mean")) / scale).drop("_mean", "_std")
    )


def scaled(value: Column, mean: Column, std: Column) -> Column:
    """Clip to three deviations, scale, clip again."""
    clipped = F.least(F.greatest(value, mean - CLIP_SIGMA * std), mean + CLIP_SIGMA * std)
    return F.least(F.greatest((clipped - mean) / std, F.lit(-CLIP_SCALED)), F.lit(CLIP_SCALED))


def fit_length(params: Column, dim: Column) -> Column:
    """Pad with zeros or cut to ``dim`` values."""
    return F.slice(F.concat(params, F.array_repeat(F.lit(0.0), dim)), F.lit(1), dim)


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def modal_dimension(parsed: DataFrame, order: tuple[str, ...] = ("stream_id", "seq")) -> DataFrame:
    """The most frequent vector length per template; ties go to the length seen first."""
    counts = (
        parsed.filter(F.size("params") > 0)
        .groupBy("log_key", F.size("params").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    )
    best = Window.partitionBy("log_key").orderBy(F.desc("n"), F.asc("first_seen"))
    return counts.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("log_key", "dim", "n")


def trainable(parsed: DataFrame, window: int, dims: DataFrame | None = None) -> DataFrame:
    """Rows with the modal vector length of templates that have more than ``window`` such rows."""
    dims = materialize(modal_dimension(parsed), "dims") if dims is None else dims
    kept = dims.filter(F.col("n") >= window + 1).select("log_key", "dim")
    rows = parsed.filter(F.size("params") > 0)
    return lookup(rows, kept, ["log_key"], "inner").filter(F.size("params") == F.col("dim"))


def position_stats(rows: DataFrame) -> DataFrame:
    """Mean and population deviation per template and position; a zero deviation counts as 1."""
    std = F.stddev_pop("value")
    return (
        rows.select("log_key", F.posexplode("params").alias("pos", "value"))
        .groupBy("log_key", "pos")
        .agg(F.avg("value").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))
    )


def with_previous(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the previous vector of the same template in the same stream, the row's number and the group's size.

    A template may hold a third of all rows of a long stream, so rows are numbered per chunk of lines
    (``nth``, ``group_rows``) and looked up per chunk of numbers (``prev``).
    """
    group = ["stream_id", "log_key"]
    numbered = dense_position(
        rows, group, ["seq"], chunk_of(F.col("seq"), chunk_rows), "nth", total="group_rows"
    )
    return windowed(
        numbered, group, "nth", {"prev": lambda spec: F.lag("params", 1).over(spec)}, back=1, chunk_rows=chunk_rows
    )


def scale_vector(column: str) -> Column:
    """A vector scaled position by position with the arrays ``means`` and ``stds``."""
    zipped = F.arrays_zip(F.col(column).alias("v"), F.col("means").alias("m"), F.col("stds").alias("s"))
    return F.transform(zipped, lambda z: scaled(z["v"], z["m"], z["s"]))


def as_arrays(stats: DataFrame) -> DataFrame:
    """Position rows folded into arrays, one row per template (a vector is short by nature)."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*[c for c in stats.columns if c != "log_key"])))
    names = {"mean": "means", "std": "stds", "slope": "slopes", "intercept": "intercepts"}
    folded = stats.select("log_key", "pos", *[c for c in stats.columns if c not in ("log_key", "pos")])
    return (
        folded.groupBy("log_key")
        .agg(sorted_rows.alias("_a"))
        .select("log_key", F.size("_a").alias("dim"), *[F.col(f"_a.{c}").alias(names[c]) for c in stats.columns if c in names])
    )


@dataclass
class ParamModel:
    """Stored tables: per-position coefficients in array form and the error threshold."""

    table: DataFrame
    window: int

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str, window: int) -> ParamModel:
        return ParamModel(spark.read.parquet(f"{path}/params"), window)


def regression(pairs: DataFrame) -> DataFrame:
    """Slope and intercept from the previous to the current scaled value, per template and position."""
    points = pairs.select(
        "log_key", F.posexplode(F.arrays_zip(F.col("now"), F.col("before"))).alias("pos", "z")
    ).select("log_key", "pos", F.col("z.now").alias("y"), F.col("z.before").alias("x"))
    flat = (F.var_pop("x") == 0) | (F.regr_count("y", "x") < 2)
    return points.groupBy("log_key", "pos").agg(
        F.when(flat, 0.0).otherwise(F.regr_slope("y", "x")).alias("slope"),
        F.when(flat, F.avg("y")).otherwise(F.regr_intercept("y", "x")).alias("intercept"),
    )


def predicted_error() -> Column:
    """Error of the predicted against the actual scaled vector."""
    guess = F.transform(
        F.arrays_zip(F.col("before").alias("b"), F.col("slopes").alias("k"), F.col("intercepts").alias("c")),
        lambda z: z["b"] * z["k"] + z["c"],
    )
    return squared_error(guess, F.col("now"))


def held_out(nth: Column, total: Column) -> Column:
    """True for the last tenth of a group's pairs; n rows give n - 1 pairs, and a single pair is not held out."""
    pair, pairs = nth - 1, total - 1
    return (pair > F.floor(pairs * (1 - HELD_OUT))) & (pairs > 1)


def train(parsed: DataFrame, window: int, chunk_rows: int = CHUNK_ROWS) -> ParamModel:
    """Fit all templates that have enough rows. Expects stream_id, seq, log_key, params."""
    rows = trainable(parsed.select("stream_id", "seq", "log_key", "params"), window)
    stats = materialize(as_arrays(position_stats(rows)), "param-stats")
    followed = with_previous(rows, chunk_rows).filter(F.col("prev").isNotNull())
    pairs = lookup(followed, stats, ["log_key"], "inner").select(
        "log_key", "nth", "group_rows", scale_vector("params").alias("now"), scale_vector("prev").alias("before")
    )
    pairs = materialize(pairs, "param-pairs")
    fit = pairs.filter(~held_out(F.col("nth"), F.col("group_rows")))
    lines = materialize(as_arrays(regression(fit)).drop("dim"), "param-lines")
    errors = (
        lookup(pairs.filter(held_out(F.col("nth"), F.col("group_rows"))), lines, ["log_key"], "inner")
        .select("log_key", predicted_error().alias("mse"))
    )
    thresholds = errors.groupBy("log_key").agg(
        (F.avg("mse") + THRESHOLD_SIGMA * F.stddev_pop("mse")).alias("mse_threshold")
    )
    table = stats.join(lines, "log_key").join(thresholds, "log_key", "left")
    return ParamModel(materialize(table, "param-model"), window)


@dataclass
class LagModel:
    """Per template the scale of each position, the coefficients of its last ``order`` values, and the error threshold."""

    table: DataFrame
    order: int


def with_lags(rows: DataFrame, order: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``lags``, the last ``order`` vectors of the same template in the same stream, newest first, and ``nth`` and ``group_rows``.

    Rows without so many vectors before them are left out.
    """
    group = ["stream_id", "log_key"]
    numbered = dense_position(rows, group, ["seq"], chunk_of(F.col("seq"), chunk_rows), "nth", total="group_rows")
    found = windowed(numbered, group, "nth", {"lags": previous("params", order)}, back=order, chunk_rows=chunk_rows)
    return found.filter(F.col("nth") > order).withColumn("lags", F.reverse("lags"))


def lag_points(rows: DataFrame, stats: DataFrame, order: int) -> DataFrame:
    """(columns of ``rows``, pos, y, x) with the scaled value of each position and its scaled last values, newest first."""
    wide = lookup(rows, stats, ["log_key"], "inner")
    points = wide.select(*rows.columns, "means", "stds", F.posexplode("params").alias("pos", "_y"))

    def scale(value: Column) -> Column:
        return scaled(value, F.element_at("means", F.col("pos") + 1), F.element_at("stds", F.col("pos") + 1))

    lag = F.transform("lags", lambda v: scale(F.coalesce(F.get(v, F.col("pos")), F.lit(0.0))))
    return points.select(*rows.columns, "pos", scale(F.col("_y")).alias("y"), lag.alias("x"))


def normal_equations(points: DataFrame, order: int) -> DataFrame:
    """Intercept and coefficients per template and position by least squares; of many solutions the one with the smallest coefficients.

    All that the equations need are sums of products, so any number of rows is one partial aggregation; each group then
    solves its own equations of ``order`` unknowns.
    """
    x = [F.element_at("x", i + 1) for i in range(order)]
    pairs = [(i, j) for i in range(order) for j in range(i, order)]
    sums = points.groupBy("log_key", "pos").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.array(*[F.sum(v) for v in x]).alias("sx"),
        F.array(*[F.sum(v * F.col("y")) for v in x]).alias("sxy"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("sxx"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, columns = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])
        for pdf in batches:
            intercepts, slopes = [], []
            for n, sy, sx, sxy, sxx in zip(pdf["n"], pdf["sy"], pdf["sx"], pdf["sxy"], pdf["sxx"]):
                gram = np.zeros((order, order))
                gram[rows, columns] = gram[columns, rows] = sxx
                mean = np.asarray(sx) / n
                k = np.linalg.pinv(gram / n - np.outer(mean, mean), rcond=1e-9, hermitian=True) @ (np.asarray(sxy) / n - mean * sy / n)
                slopes.append(k.tolist())
                intercepts.append(float(sy / n - k @ mean))
            yield pdf[["log_key", "pos"]].assign(intercept=intercepts, slopes=slopes)

    return sums.mapInPandas(solve, "log_key string, pos int, intercept double, slopes array<double>")


def lag_errors(points: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared error of each vector, given by ``keys`` and log_key."""
    guess = F.aggregate(F.zip_with("x", "slopes", lambda v, k: v * k), F.col("intercept"), lambda total, v: total + v)
    joined = lookup(points, fit, ["log_key", "pos"], "inner")
    return joined.groupBy(*keys, "log_key").agg(F.avg((guess - F.col("y")) * (guess - F.col("y"))).alias("mse"))


def train_lags(parsed: DataFrame, order: int, window: int | None = None, chunk_rows: int = CHUNK_ROWS) -> LagModel:
    """Fit the next vector from the last ``order`` ones for all templates with more than ``window`` (by default ``order``) vectors.

    The last tenth of each stream's vectors of a template is held out for the threshold.
    """
    rows = trainable(parsed.select("stream_id", "seq", "log_key", "params"), window or order)
    stats = materialize(as_arrays(position_stats(rows)), "lag-stats")
    lagged = with_lags(rows.drop("dim"), order, chunk_rows)
    held = held_out(F.col("nth") - order + 1, F.col("group_rows") - order + 1)
    points = materialize(lag_points(lagged.withColumn("held", held), stats, order).drop("params", "lags"), "lag-points")
    fit = materialize(normal_equations(points.filter(~F.col("held")), order), "lag-fit")
    errors = lag_errors(points.filter("held"), fit, ["stream_id", "seq"])
    thresholds = errors.groupBy("log_key").agg((F.avg("mse") + THRESHOLD_SIGMA * F.stddev_pop("mse")).alias("mse_threshold"))
    folded = fit.groupBy("log_key").agg(F.array_sort(F.collect_list(F.struct("pos", "intercept", "slopes"))).alias("fit"))
    table = stats.join(folded, "log_key").join(thresholds, "log_key", "left")
    return LagModel(materialize(table, "lag-model"), order)


def score_lags(good: DataFrame, model: LagModel, window: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(stream_id, seq, mse, mse_threshold) of vectors (stream_id, seq, log_key, params) with more than ``window`` ones before them."""
    table = model.table
    lagged = with_lags(good, model.order, chunk_rows).filter(F.col("nth") > (window or model.order))
    fitted = lookup(lagged, table.select("log_key", "dim"), ["log_key"], "inner").withColumn("params", fit_length(F.col("params"), F.col("dim")))
    points = lag_points(fitted.select("stream_id", "seq", "log_key", "params", "lags"), table.select("log_key", "means", "stds"), model.order)
    fit = table.select("log_key", F.inline("fit"))
    errors = lag_errors(points, fit, ["stream_id", "seq"])
    return lookup(errors, table.select("log_key", "mse_threshold"), ["log_key"]).select("stream_id", "seq", "mse", "mse_threshold")


def detect_params(keyed: DataFrame, model: ParamModel, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add mse and param_anomaly to the output of key detection.

    Only lines without a key anomaly count as history of their template in their stream. With fewer
    than ``window`` of them, or without a model, a line is normal.
    """
    good = keyed.filter(~F.col("key_anomaly") & (F.size("params") > 0)).select(
        "stream_id", "seq", "log_key", "params"
    )
    scored = score_vectors(with_previous(good, chunk_rows), model)
    return keyed.join(scored, ["stream_id", "seq"], "left").withColumn(
        "param_anomaly", F.coalesce(F.col("mse") > F.col("mse_threshold"), F.lit(False))
    )


def score_vectors(followed: DataFrame, model: ParamModel) -> DataFrame:
    """(stream_id, seq, mse, mse_threshold) of vectors with enough history; reads params, prev and nth."""
    ready = followed.filter(F.col("nth") > model.window)
    fitted = lookup(ready, model.table, ["log_key"], "inner").withColumns(
        {"params": fit_length(F.col("params"), F.col("dim")), "prev": fit_length(F.col("prev"), F.col("dim"))}
    )
    scored = fitted.withColumns({"now": scale_vector("params"), "before": scale_vector("prev")})
    return scored.select("stream_id", "seq", predicted_error().alias("mse"), "mse_threshold")


def label_anomalies(detected: DataFrame) -> DataFrame:
    """Add anomaly_type (path, parameter, normal) and is_anomaly; a path anomaly wins."""
    kind = F.when(F.col("key_anomaly"), "path").when(F.col("param_anomaly"), "parameter").otherwise("normal")
    return detected.withColumn("anomaly_type", kind).withColumn("is_anomaly", F.col("anomaly_type") != "normal")
