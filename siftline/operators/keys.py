"""Next-key model: vocabulary, windows, back-off counts, detection, updates.

The model answers "which templates follow the last w templates". It is a table of counts for histories of
length w down to 0; a history that was never seen falls back to its longest known ending. Counts add up,
so training is one partial aggregation and an update is a union and a sum. Templates are long texts, so the
model and all windows hold their vocabulary numbers; -1 stands for any template outside the vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.evaluate import once
from ..session import materialize
from .joins import lookup
from .sequences import CHUNK_ROWS, dense_position, last_known, previous, range_position, windowed

WINDOW = 10
TOP_G = 5
UNKNOWN = -1


def parse_lines(
    lines: DataFrame, given_ts: str | None = None, parts: Sequence[str] = ("ts", "level", "log_key", "params")
) -> DataFrame:
    """Add ts, level, log_key and params (or fewer) to (stream_id, seq, raw).

    ``given_ts`` names a column whose time wins over the line's own. Every part is computed once per line,
    whatever later steps do with it.
    """
    ts = text.timestamp(F.col("raw"))
    make = {
        "ts": F.coalesce(F.col(given_ts), ts) if given_ts else ts,
        "level": text.level(F.col("raw")),
        "log_key": text.log_key(F.col("raw")),
        "params": text.parameters(F.col("raw")),
    }
    parsed = once(lines, "_line", F.struct(*[make[p].alias(p) for p in parts]))
    return parsed.withColumns({p: F.col(f"_line.{p}") for p in parts}).drop("_line")


def with_time_delta(parsed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``time_delta``, the seconds to the last line of the stream that has a time."""
    known = last_known(parsed, ["stream_id"], "seq", "ts", "_before", chunk_rows)
    return known.withColumn(
        "time_delta", F.when(F.col("ts").isNotNull(), text.seconds_between(F.col("_before"), F.col("ts")))
    ).drop("_before")


def with_delta_first(parsed: DataFrame) -> DataFrame:
    """The time delta, where there is one, in front of the parameters."""
    return parsed.withColumn(
        "params",
        F.when(F.col("time_delta").isNotNull(), F.concat(F.array("time_delta"), "params")).otherwise(F.col("params")),
    )


def parse_streams(
    lines: DataFrame, given_ts: str | None = None, chunk_rows: int = CHUNK_ROWS, parts: Sequence[str] = ("level", "log_key", "params")
) -> DataFrame:
    """Everything about a line: ts, time_delta, level, log_key, and params with the delta in front; ``parts`` may leave out the level.

    Times come first, as the deltas read the lines twice; templates and parameters are then computed once.
    """
    timed = with_time_delta(parse_lines(lines, given_ts, ["ts"]), chunk_rows)
    return with_delta_first(parse_lines(timed, parts=parts))


def by_identifier(
    lines: DataFrame, identifier: Column | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Regroup lines into streams named in the lines themselves, numbered anew in line order."""
    named = lines.withColumnRenamed("stream_id", "_source").withColumnRenamed("seq", "_line")
    named = named.withColumn("stream_id", text.stream_identifier(F.col("raw")) if identifier is None else identifier)
    bucket = F.struct(F.col("_source"), F.floor(F.col("_line") / chunk_rows).alias("_part"))
    return dense_position(named, ["stream_id"], ["_source", "_line"], bucket).drop("_source", "_line")


def vocabulary(parsed: DataFrame) -> DataFrame:
    """Distinct templates in order with a 0-based index; templates that begin alike are numbered by as many tasks as others."""
    distinct = materialize(parsed.select("log_key").distinct(), "templates")
    return range_position(distinct, ["log_key"], "idx").select("log_key", "idx")


def grow_vocabulary(vocab: DataFrame, parsed: DataFrame) -> DataFrame:
    """The vocabulary plus the new templates, which get the next indexes in alphabetical order."""
    fresh = vocabulary(new_keys(vocab, parsed))
    size = vocab.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("_size"))
    return vocab.unionByName(
        fresh.join(F.broadcast(size)).select("log_key", (F.col("idx") + F.col("_size")).alias("idx"))
    )


def new_keys(vocab: DataFrame, parsed: DataFrame) -> DataFrame:
    """Templates that the vocabulary lacks."""
    return parsed.select("log_key").distinct().join(vocab.select("log_key"), "log_key", "left_anti")


def one_hot(parsed: DataFrame, vocab: DataFrame, column: str = "log_key") -> DataFrame:
    """The one-hot position of each template and the vector's size; unknown templates have no position."""
    size = vocab.agg(F.count(F.lit(1)).alias("width"))
    return lookup(parsed, vocab.withColumnRenamed("log_key", column), [column]).join(F.broadcast(size))


def encode(parsed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``key_id``, the vocabulary number of the template or -1."""
    return lookup(parsed, vocab, ["log_key"]).withColumn("key_id", F.coalesce("idx", F.lit(UNKNOWN))).drop("idx")


def with_history(
    parsed: DataFrame, window: int = WINDOW, chunk_rows: int = CHUNK_ROWS, column: str = "log_key"
) -> DataFrame:
    """Add ``hist``, the last ``window`` values of the stream; null until there are that many."""
    return windowed(
        parsed, ["stream_id"], "seq", {"_hist": previous(column, window)}, back=window, chunk_rows=chunk_rows
    ).withColumn("hist", F.when(F.col("seq") > window, F.col("_hist"))).drop("_hist")


def training_windows(
    parsed: DataFrame, window: int = WINDOW, chunk_rows: int = CHUNK_ROWS, column: str = "log_key"
) -> DataFrame:
    """Every (history, next value) pair; none for a stream no longer than the window."""
    return (
        with_history(parsed.select("stream_id", "seq", column), window, chunk_rows, column)
        .filter(F.col("hist").isNotNull())
        .select("stream_id", "seq", "hist", F.col(column).alias("label"))
    )


def count_windows(windows: DataFrame) -> DataFrame:
    """Counts of (history ending, label) for every length of ending.

    Full histories are counted first, so that the step to shorter endings works on distinct pairs.
    """
    return _all_endings(windows.groupBy("hist", "label").agg(F.count(F.lit(1)).alias("n")))


def _all_endings(full: DataFrame) -> DataFrame:
    endings = F.transform(
        F.sequence(F.lit(0), F.size("hist")),
        lambda k: F.struct(k.alias("length"), F.slice("hist", F.size("hist") - k + 1, k).alias("hist")),
    )
    return (
        full.select(F.explode(endings).alias("e"), "label", "n")
        .groupBy(F.col("e.length").alias("length"), F.col("e.hist").alias("hist"), "label")
        .agg(F.sum("n").alias("n"))
    )


def top_predictions(counts: DataFrame, top_g: int = TOP_G) -> DataFrame:
    """Per history the ``top_g`` most likely labels with probabilities; ties in alphabetical order."""
    ranking = Window.partitionBy("length", "hist").orderBy(F.desc("n"), F.asc("label"))
    best = counts.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= top_g)
    totals = counts.groupBy("length", "hist").agg(F.sum("n").alias("total"))
    return (
        best.join(totals, ["length", "hist"])
        .groupBy("length", "hist")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", F.col("label").alias("key"), (F.col("n") / F.col("total")).alias("prob")))
            ).alias("_p")
        )
        .select(
            "length", "hist",
            F.transform("_p", lambda p: F.struct(p["key"].alias("key"), p["prob"].alias("prob"))).alias("predictions"),
        )
    )


@dataclass
class KeyModel:
    """Stored tables of a trained model.

    ``counts`` holds (length, hist, label, n) with vocabulary numbers, ``contexts`` the best labels per
    history as names with probabilities and as numbers (``ids``).
    """

    counts: DataFrame
    contexts: DataFrame
    vocab: DataFrame
    window: int
    top_g: int

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.contexts.write.mode("overwrite").parquet(f"{path}/contexts")
        spark = self.counts.sparkSession
        spark.createDataFrame([(self.window, self.top_g)], "window int, top_g int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KeyModel:
        settings = spark.read.parquet(f"{path}/settings").first()
        return KeyModel(
            spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/contexts"),
            spark.read.parquet(f"{path}/vocab"), settings["window"], settings["top_g"],
        )

    def named_counts(self) -> DataFrame:
        """The counts with template names instead of numbers."""
        return _translate(self.counts, self.vocab, "idx", "log_key")


def _translate(counts: DataFrame, vocab: DataFrame, source: str, target: str) -> DataFrame:
    """Counts with every history item and label looked up in the vocabulary; a history is short by nature."""
    row = [c for c in counts.columns]
    items = counts.select(*row, F.posexplode(F.concat(F.array("label"), "hist")).alias("_pos", source))
    found = lookup(items, vocab, [source], "inner")
    folded = found.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("_pos", target))).alias("_items"))
    names = F.col(f"_items.{target}")
    return folded.withColumns({"label": F.element_at(names, 1), "hist": F.slice(names, 2, F.size(names))}).drop("_items")


def model_from_counts(counts: DataFrame, vocab: DataFrame, window: int, top_g: int) -> KeyModel:
    named = lookup(
        counts.withColumnRenamed("label", "idx"), vocab.withColumnRenamed("log_key", "label"), ["idx"], "inner"
    )
    best = top_predictions(named.drop("idx"), top_g)
    listed = best.select("length", "hist", "predictions", F.posexplode("predictions").alias("_pos", "_p"))
    coded = lookup(listed.withColumn("log_key", F.col("_p.key")), vocab, ["log_key"], "inner")
    contexts = coded.groupBy("length", "hist").agg(
        F.any_value("predictions").alias("predictions"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "idx"))), lambda r: r["idx"]).alias("ids"),
    )
    return KeyModel(counts, materialize(contexts, "contexts"), vocab, window, top_g)


def train(parsed: DataFrame, window: int = WINDOW, top_g: int = TOP_G, chunk_rows: int = CHUNK_ROWS) -> KeyModel:
    """Count the training lines once and store the model tables."""
    vocab = materialize(vocabulary(parsed), "vocab")
    coded = encode(parsed.select("stream_id", "seq", "log_key"), vocab)
    counts = count_windows(training_windows(coded, window, chunk_rows, "key_id"))
    return model_from_counts(materialize(counts, "counts"), vocab, window, top_g)


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of two models added up; equals training on both sets of windows."""
    return old.unionByName(new).groupBy("length", "hist", "label").agg(F.sum("n").alias("n"))


def update(
    model: KeyModel, parsed: DataFrame, marks: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS
) -> KeyModel:
    """A new model version that also knows the given lines.

    With ``marks``, (stream_id, seq) of some of them, only these are learned, after the lines before them.
    """
    vocab = materialize(grow_vocabulary(model.vocab, parsed), "vocab")
    windows = training_windows(
        encode(parsed.select("stream_id", "seq", "log_key"), vocab), model.window, chunk_rows, "key_id"
    )
    if marks is not None:
        windows = windows.join(marks.select("stream_id", "seq"), ["stream_id", "seq"], "left_semi")
    counts = materialize(merge_counts(model.counts, count_windows(windows)), "counts")
    return model_from_counts(counts, vocab, model.window, model.top_g)


def apply_feedback(model: KeyModel, parsed: DataFrame, false_alarms: DataFrame) -> KeyModel:
    """Learn the lines of ``parsed`` that a user marked as false alarms, given as (stream_id, seq)."""
    return update(model, parsed, false_alarms)


def learn_windows(model: KeyModel, windows: DataFrame) -> KeyModel:
    """A new model version that also knows the given (hist, label) rows of template names."""
    pairs = materialize(windows.groupBy("hist", "label").agg(F.count(F.lit(1)).alias("n")), "new-windows")
    seen = pairs.select(F.explode(F.concat(F.array("label"), "hist")).alias("log_key"))
    vocab = materialize(grow_vocabulary(model.vocab, seen), "vocab")
    coded = _translate(pairs, vocab, "log_key", "idx")
    counts = materialize(merge_counts(model.counts, _all_endings(coded)), "counts")
    return model_from_counts(counts, vocab, model.window, model.top_g)


def predict(model: KeyModel, histories: DataFrame) -> DataFrame:
    """Predictions for distinct full histories, from the longest ending that the model knows.

    ``order_used`` is the length of this ending. Takes and returns one row per ``hist`` of numbers.
    """
    endings = F.transform(
        F.sequence(F.lit(0), F.size("hist")),
        lambda k: F.struct(k.alias("length"), F.slice("hist", F.size("hist") - k + 1, k).alias("ending")),
    )
    wanted = histories.select("hist", F.explode(endings).alias("e")).select("hist", "e.length", "e.ending")
    known = model.contexts.withColumnRenamed("hist", "ending")
    best = F.max_by(F.struct("predictions", "ids"), "length")
    return (
        wanted.join(known, ["length", "ending"])
        .groupBy("hist")
        .agg(F.max("length").alias("order_used"), best.alias("_b"))
        .select("hist", "order_used", "_b.predictions", "_b.ids")
    )


def detect_keys(parsed: DataFrame, model: KeyModel, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add hist, predictions, order_used, in_vocab and key_anomaly.

    A template outside the vocabulary is an anomaly; with a full history, so is one outside the top
    predictions. The decision is made once per distinct (history, template) and then looked up, so that
    a frequent history costs no more than a rare one.
    """
    return decide_keys(with_history(encode(parsed, model.vocab), model.window, chunk_rows, "key_id"), model)


def decide_keys(rows: DataFrame, model: KeyModel) -> DataFrame:
    """The decision of ``detect_keys`` for rows that have key_id and hist already."""
    pairs = materialize(rows.groupBy("hist", "key_id").agg(F.count(F.lit(1)).alias("n")), "pairs")
    answers = materialize(predict(model, pairs.select("hist").filter(F.col("hist").isNotNull()).distinct()), "answers")
    no_history = F.array().cast("array<bigint>")
    unexpected = ~F.coalesce(F.array_contains("ids", F.col("key_id")), F.lit(False))
    decided = lookup(pairs, answers, ["hist"]).select(
        F.coalesce("hist", no_history).alias("_hist"), "key_id", (F.col("key_id") != UNKNOWN).alias("in_vocab"),
        "order_used", "predictions",
        F.when(F.col("key_id") == UNKNOWN, True).when(F.col("hist").isNull(), False).otherwise(unexpected).alias("key_anomaly"),
    )
    decided = materialize(decided, "decisions")
    keyed = rows.withColumn("_hist", F.coalesce("hist", no_history))
    return lookup(keyed, decided, ["_hist", "key_id"]).drop("_hist")
