"""Sequence detection on a stream of lines, on Spark's own keyed state.

Two streaming queries follow each other. The first keeps, per stream, the last w templates, the last number and the last time
(``applyInPandasWithState``), gives every line its history and decides on its template by joins with the stored model. The
second keeps, per stream, the number of vectors and the last one of each template, and scores the parameters. Each writes to a
file sink; states, offsets and sinks belong to Spark, so a restart goes on where the last batch ended and repeats nothing.
Lines are parsed before the keyed step and looked up after it, so the task of a busy stream only slides its window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.evaluate import once
from ..operators import keys, params
from ..operators.joins import lookup

KEY_STATE = "n bigint, last_seq bigint, last_at bigint, tail array<bigint>, since bigint"
VECTOR_STATE = "since bigint, log_keys array<string>, nth array<bigint>, params array<string>"
PARSED = "seq bigint, at bigint, key_id bigint, reset boolean, params array<double>, log_key string"
SEEN = "seq bigint, at bigint, key_id bigint, delta double, hist array<bigint>, since bigint, late boolean, params array<double>, log_key string"
KEYED = "stream_id string, seq bigint, event_time timestamp, log_key string, params array<double>, since bigint, late boolean, key_anomaly boolean"
COUNTED = "seq bigint, counts boolean, since bigint, late boolean, key_anomaly boolean, params array<double>, log_key string"
FOLLOWED = "nth bigint, prev array<double>, seq bigint, late boolean, key_anomaly boolean, params array<double>, log_key string"
RESULTS = "stream_id string, seq bigint, log_key string, anomaly_type string, key_anomaly boolean, param_anomaly boolean, mse double, late boolean"
LINES = "stream_id string, line string"
MICROS = 1_000_000


def columns(schema: str) -> list[list[str]]:
    """The names and types of a schema of flat columns and arrays."""
    return [c.split() for c in schema.split(", ")]


def names(schema: str) -> list[str]:
    return [name for name, _ in columns(schema)]


def as_line(schema: str) -> Column:
    """The columns of a schema, of which the last may be a string, as one text with tabs between them; nulls are empty.

    Most groups are a few rows, and each column of a group costs more than its rows, so a row is one text on its way to and from
    a state. A string that is not null begins with ``+``, and only it may hold tabs; an array stands in brackets.
    """
    parts = []
    for name, kind in columns(schema):
        value = F.col(name).cast("string")
        if kind.startswith("array"):
            value = F.concat(F.lit("["), F.array_join(F.col(name).cast("array<string>"), ",", "null"), F.lit("]"))
        elif kind == "string":
            value = F.concat(F.lit("+"), value)
        parts.append(F.coalesce(value, F.lit("")))
    return F.concat_ws("\t", *parts)


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """stream_id and the columns of a schema from rows (stream_id, line)."""
    kinds = columns(schema)
    split = once(lines, "_parts", F.split("line", "\t", len(kinds)))
    found = []
    for i, (name, kind) in enumerate(kinds):
        value = F.col("_parts")[i]
        if kind.startswith("array"):
            items = F.split(F.substring(value, F.lit(2), F.length(value) - 2), ",")
            empty = F.array().cast(kind)
            found.append(F.when(value == "[]", empty).when(value != "", items.try_cast(kind)).alias(name))
        elif kind == "string":
            found.append(F.when(value != "", F.substring(value, F.lit(2), F.length(value))).alias(name))
        else:
            found.append(value.try_cast(kind).alias(name))
    return split.select("stream_id", *found)


def rows_of(batches: Iterable[pd.DataFrame], schema: str) -> list[list[str]]:
    """The texts of the columns of every row of one group."""
    tabs = len(columns(schema)) - 1
    return [line.split("\t", tabs) for rows in batches for line in rows["line"].tolist()]


def frame_of(stream_id: str | None, lines: list[str]) -> pd.DataFrame:
    """One stream's rows (stream_id, line) as one block, which is made and put together faster than columns."""
    cells = np.empty((len(lines), 2), dtype=object)
    cells[:, 0], cells[:, 1] = stream_id, lines
    return pd.DataFrame(cells, columns=["stream_id", "line"], copy=False)


def text(value: float | None) -> str:
    return "" if value is None else str(value)


def array_text(values: list[int] | None) -> str:
    return "" if values is None else f"[{','.join(map(str, values))}]"


def histories(tail: list[int], ids: list[int], window: int) -> tuple[list[list[int] | None], list[int]]:
    """The full history before each of the new ids, null until there is one, and the ids to remember."""
    known = [*tail, *ids]
    first = len(tail)
    return [known[i - window : i] if i >= window else None for i in range(first, len(known))], known[-window:] if window else []


def deltas(at: list[int | None], last_at: int | None) -> tuple[list[float | None], int | None]:
    """The seconds since the last line that has a time, where there are any, and the last time."""
    out = []
    for now in at:
        out.append(None if now is None or last_at is None else (now - last_at) / MICROS)
        last_at = last_at if now is None else now
    return out, last_at


def segments(at: list[int | None], resets: list[bool], last_at: int | None, gap: float | None) -> Iterator[tuple[int, int, bool]]:
    """Runs of lines (from, to, fresh) that share a history: a reset, or a quiet time of more than ``gap`` seconds, begins anew."""
    begin, fresh = 0, False
    for i, (now, reset) in enumerate(zip(at, resets)):
        quiet = gap is not None and now is not None and last_at is not None and now - last_at > gap * MICROS
        if reset or quiet:
            if i > begin:
                yield begin, i, fresh
            begin, fresh = i, True
        last_at = None if reset else last_at if now is None else now
    if len(at) > begin:
        yield begin, len(at), fresh


@dataclass
class StreamDetector:
    """Detects on every line of a stream and appends (stream_id, seq, …, anomaly_type, late) to a folder.

    ``lines`` has stream_id, seq, raw and, if streams can be reset, ``reset``: a row with ``reset`` true makes its stream forget
    everything before the line of that number, and gives no result. A line whose number is not above the last one of its
    stream is late: it is reported with ``late = true`` and type ``normal`` and does not change the state; of lines that
    arrive together with one number, all but one are late.

    With ``forget_after``, a stream forgets its history after a quiet time of more than that many seconds between two of its
    lines. States that nothing can need any more are then dropped by the watermark; lines more than ``late`` older than
    the newest line of earlier batches are dropped with it, as in any query on event time. Without it, nothing is dropped.
    """

    key_model: keys.KeyModel
    param_model: params.ParamModel
    path: str
    forget_after: float | None = None
    late: str = "1 day"

    def __post_init__(self):
        self.spark: SparkSession = self.key_model.counts.sparkSession

    # --- first query: histories and templates -----------------------------------------------------------

    def keyed(self, lines: DataFrame) -> DataFrame:
        """Template decisions on a streaming DataFrame."""
        reset = F.coalesce("reset", F.lit(False)) if "reset" in lines.columns else F.lit(False)
        named = lines.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "raw", reset.alias("reset"))
        parsed = keys.encode(keys.parse_lines(named, parts=["ts", "log_key", "params"]), self.key_model.vocab)
        time = F.col("ts").cast("timestamp")
        rows = parsed.withColumns({"event_time": time, "at": F.unix_micros(time)})
        line = as_line(PARSED).alias("line")
        if self.forget_after is not None:
            rows = rows.select("stream_id", "event_time", line).withWatermark("event_time", self.late)
        else:
            rows = rows.select("stream_id", line)
        lines = rows.groupBy("stream_id").applyInPandasWithState(
            self._history(), LINES, KEY_STATE, "append",
            GroupStateTimeout.EventTimeTimeout if self.forget_after is not None else GroupStateTimeout.NoTimeout,
        )
        seen = from_lines(lines, SEEN)
        delta = F.when(F.col("delta").isNotNull(), F.array("delta")).otherwise(F.array().cast("array<double>"))
        values = F.concat(delta, F.coalesce("params", F.array().cast("array<double>")))
        seen = seen.withColumns({
            "event_time": F.timestamp_micros("at"), "params": F.when(F.col("late"), F.col("params")).otherwise(values),
        })
        return self._decided(seen).select(*names(KEYED))

    def _history(self):
        window, gap = self.key_model.window, self.forget_after

        def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            n, last_seq, last_at, tail, since = state.get if state.exists else (0, None, None, [], None)
            tail = list(tail)
            rows = [
                (int(seq), int(at) if at else None, int(key_id), reset == "true", values, log_key)
                for seq, at, key_id, reset, values, log_key in rows_of(batches, PARSED)
            ]
            rows.sort(key=lambda row: (row[0], not row[3]))
            fresh, old, before = [], [], None
            for row in rows:
                repeated = before is not None and before[0] == row[0] and not row[3] and not before[3]
                before = row
                if not repeated and (last_seq is None or row[0] > last_seq):
                    fresh.append(row)
                elif not row[3]:
                    old.append(row)
            out = []
            for begin, end, anew in segments([row[1] for row in fresh], [row[3] for row in fresh], last_at, gap):
                if anew:
                    n, tail, last_at, since = 0, [], None, None
                part = [row for row in fresh[begin:end] if not row[3]]
                if not part:
                    continue
                since = part[0][0] if since is None else since
                hists, tail = histories(tail, [row[2] for row in part], window)
                passed, last_at = deltas([row[1] for row in part], last_at)
                n += len(part)
                last_seq = part[-1][0]
                out += [
                    f"{seq}\t{text(now)}\t{key_id}\t{text(delta)}\t{array_text(hist)}\t{since}\tfalse\t{values}\t{log_key}"
                    for (seq, now, key_id, _, values, log_key), delta, hist in zip(part, passed, hists)
                ]
            state.update((n, last_seq, last_at, tail, since))
            if gap is not None:
                newest = max(last_at or 0, 0) // 1000
                state.setTimeoutTimestamp(max(int(newest + gap * 1000), state.getCurrentWatermarkMs()) + 1)
            out += [f"{seq}\t{text(now)}\t{key_id}\t\t\t\ttrue\t{values}\t{log_key}" for seq, now, key_id, _, values, log_key in old]
            if out:
                yield frame_of(key[0], out)

        return remember

    def _decided(self, seen: DataFrame) -> DataFrame:
        """Add key_anomaly by the longest ending of the history that the model knows.

        The model knows every ending of an ending it knows, so the longest one is found by bisection: a few lookups by (length,
        ending), whatever the window's length. The empty ending has one answer for all lines.
        """
        contexts = self.key_model.contexts.select(F.col("length").alias("_length"), F.col("hist").alias("_ending"), F.col("ids").alias("_found"))
        first = self.key_model.contexts.where("length = 0").select("ids").first()
        none = F.array(*[F.lit(i) for i in (first["ids"] if first else [])]).cast("array<bigint>")
        rows = seen.withColumns({"_low": F.lit(0), "_high": F.lit(self.key_model.window), "_ids": none})
        for _ in range(self.key_model.window.bit_length()):
            middle = F.floor((F.col("_low") + F.col("_high") + 1) / 2).cast("int")
            # A line whose search has ended, or without a full history, asks for an ending that no table has.
            asks = F.col("hist").isNotNull() & (F.col("_low") < F.col("_high"))
            rows = rows.withColumns({
                "_length": F.when(asks, middle).otherwise(-1),
                "_ending": F.when(asks, F.slice("hist", F.size("hist") - middle + 1, middle)).otherwise(F.array().cast("array<bigint>")),
            })
            rows = lookup(rows, contexts, ["_length", "_ending"])
            hit, asked = F.col("_found").isNotNull(), F.col("_length") >= 0
            rows = rows.withColumns({
                "_low": F.when(hit, F.col("_length")).otherwise(F.col("_low")),
                "_high": F.when(asked & ~hit, F.col("_length") - 1).otherwise(F.col("_high")),
                "_ids": F.coalesce("_found", "_ids"),
            }).drop("_length", "_ending", "_found")
        unknown = F.col("key_id") == keys.UNKNOWN
        anomaly = F.when(F.col("late"), False).when(unknown, True).when(F.col("hist").isNull(), False).otherwise(
            ~F.array_contains("_ids", F.col("key_id"))
        )
        return rows.withColumn("key_anomaly", anomaly)

    # --- second query: parameter vectors ----------------------------------------------------------------

    def scored(self, keyed: DataFrame) -> DataFrame:
        """Results of a streaming DataFrame of template decisions."""
        counts = ~(F.col("late") | F.coalesce("key_anomaly", F.lit(False))) & (F.coalesce(F.size("params"), F.lit(0)) > 0)
        keyed = keyed.withColumn("counts", counts)
        line = as_line(COUNTED).alias("line")
        if self.forget_after is not None:
            rows = keyed.select("stream_id", "event_time", line).withWatermark("event_time", self.late)
        else:
            rows = keyed.select("stream_id", line)
        lines = rows.groupBy("stream_id").applyInPandasWithState(
            self._previous(), LINES, VECTOR_STATE, "append",
            GroupStateTimeout.EventTimeTimeout if self.forget_after is not None else GroupStateTimeout.NoTimeout,
        )
        followed = from_lines(lines, FOLLOWED)
        table = self.param_model.table.withColumn("_fitted", F.lit(True))
        fitted = lookup(followed, table, ["log_key"])
        ready = F.col("_fitted").isNotNull() & (F.col("nth") > self.param_model.window)
        fitted = fitted.withColumns({
            c: F.when(ready, params.fit_length(F.col(c), F.col("dim"))) for c in ("params", "prev")
        })
        values = fitted.withColumns({"now": params.scale_vector("params"), "before": params.scale_vector("prev")})
        values = values.withColumn("mse", F.when(ready, params.predicted_error()))
        values = values.withColumn("param_anomaly", F.coalesce(F.col("mse") > F.col("mse_threshold"), F.lit(False)))
        return params.label_anomalies(values).select(*names(RESULTS))

    def _previous(self):
        gap = self.forget_after

        def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            since, log_keys, nths, vectors = state.get if state.exists else (None, [], [], [])
            known = dict(zip(log_keys, zip(nths, vectors)))  # templates and vectors stay the texts that they come as
            frames = list(batches)
            out = []
            for seq, counts, begun, late, anomaly, values, log_key in sorted(rows_of(frames, COUNTED), key=lambda row: int(row[0])):
                nth, prev = 0, ""
                if counts == "true":
                    if since != int(begun):
                        since, known = int(begun), {}
                    nth, prev = known.get(log_key, (0, ""))
                    nth += 1
                    known[log_key] = (nth, values)
                out.append(f"{nth}\t{prev}\t{seq}\t{late}\t{anomaly}\t{values}\t{log_key}")
            state.update((since, list(known), [nth for nth, _ in known.values()], [values for _, values in known.values()]))
            if gap is not None:
                newest = pd.concat([rows["event_time"] for rows in frames]).max()
                newest = 0 if pd.isna(newest) else int(newest.timestamp() * 1000)
                state.setTimeoutTimestamp(max(int(newest + gap * 1000), state.getCurrentWatermarkMs()) + 1)
            yield frame_of(key[0], out)

        return follow

    # --- running --------------------------------------------------------------------------------------------

    def _sink(self, rows: DataFrame, name: str, trigger: dict) -> StreamingQuery:
        writer = rows.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", f"{self.path}/{name}").option("checkpointLocation", f"{self.path}/{name}-offsets")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def start_keys(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """The first query, from lines to template decisions."""
        return self._sink(self.keyed(lines), "keyed", trigger)

    def start_values(self, **trigger) -> StreamingQuery:
        """The second query, from the first one's folder to results. The folder must exist."""
        return self._sink(self.scored(self.spark.readStream.schema(KEYED).parquet(f"{self.path}/keyed")), "results", trigger)

    def run_available(self, lines: DataFrame) -> None:
        """Handle everything that has arrived and stop; the next call goes on from there."""
        for start in (lambda: self.start_keys(lines, availableNow=True), lambda: self.start_values(availableNow=True)):
            start().awaitTermination()

    def results(self) -> DataFrame:
        """All rows written so far."""
        return self.spark.read.schema(RESULTS).parquet(f"{self.path}/results")


class OnlineModel:
    """A key model that learns from micro-batches of normal windows, one stored version per batch.

    A repeated batch starts from the version before it, so nothing is counted twice.
    """

    def __init__(self, model: keys.KeyModel, path: str):
        self.path, self.window, self.top_g = path, model.window, model.top_g
        self.spark = model.counts.sparkSession
        model.save(f"{path}/version--1")
        self.latest = -1

    def version(self, batch_id: int) -> keys.KeyModel:
        return keys.KeyModel.load(self.spark, f"{self.path}/version-{batch_id}")

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        """Add (hist, label) rows of a micro-batch."""
        new = keys.learn_windows(self.version(batch_id - 1), batch.select("hist", "label"))
        new.save(f"{self.path}/version-{batch_id}")
        self.latest = batch_id
