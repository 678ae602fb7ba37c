"""The stream detector against the batch detector: pieces, late lines, restarts, resets, quiet times."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.operators import keys, params
from siftline.plans import stream_queries
from siftline.streaming.detector import StreamDetector, as_line, from_lines, segments

from .test_models import text_lines

SCHEMA = "stream_id string, seq bigint, raw string, reset boolean"


@pytest.fixture(scope="module")
def models(spark):
    train = keys.parse_streams(spark.createDataFrame(text_lines(120, 0, "t"), "stream_id string, seq bigint, raw string"))
    return keys.train(train, 3, 2), params.train(train, 3)


def plain(part):
    return [(*row, False) if len(row) == 3 else row for row in part]


def run(spark, tmp_path, models, parts, **how):
    """Every part arrives as a file of its own and is handled by a fresh detector, as after a restart."""
    arrivals = str(tmp_path / "arrivals")
    for part in parts:
        spark.createDataFrame(plain(part), SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        detector = StreamDetector(*models, str(tmp_path / "d"), **how)
        detector.run_available(spark.readStream.schema(SCHEMA).parquet(arrivals))
    return detector.results().collect()


def batch(spark, models, data):
    whole = keys.parse_streams(spark.createDataFrame(data, "stream_id string, seq bigint, raw string"))
    found = params.label_anomalies(params.detect_params(keys.detect_keys(whole, models[0]), models[1]))
    return {(r.stream_id, r.seq): (r.anomaly_type, r.mse and round(r.mse, 9)) for r in found.collect()}


def named(rows):
    assert len({(r.stream_id, r.seq, r.late) for r in rows}) == len(rows)
    return {(r.stream_id, r.seq): (r.anomaly_type, r.mse and round(r.mse, 9)) for r in rows if not r.late}


def test_pieces_with_restarts_equal_one_batch(spark, tmp_path, models):
    data = text_lines(70, 1, "a") + text_lines(40, 2, "b")
    cuts = [data[0:25] + data[70:71], data[25:27] + data[71:90], data[27:70] + data[90:]]
    assert named(run(spark, tmp_path, models, cuts)) == batch(spark, models, data)


def test_late_and_repeated_lines_change_nothing(spark, tmp_path, models):
    data = text_lines(60, 1, "a")
    on_time = [r for r in data if r[1] not in (7, 30)]
    parts = [on_time[:20], on_time[20:40] + [data[6], data[2]], [data[29], *on_time[40:], on_time[-1]]]
    rows = run(spark, tmp_path, models, parts)
    assert sorted(r.seq for r in rows if r.late) == [3, 7, 30, 60]
    assert all(r.anomaly_type == "normal" and r.mse is None for r in rows if r.late)
    assert named(rows) == batch(spark, models, on_time)


def test_a_reset_forgets_only_its_stream(spark, tmp_path, models):
    a, b = text_lines(40, 1, "a"), text_lines(40, 2, "b")
    parts = [a[:15] + b[:20], [*a[15:25], ("a", 21, None, True), *b[20:30]], [*a[25:], *b[30:], ("z", 5, None, True)]]
    want = batch(spark, models, a[:20]) | batch(spark, models, a[20:]) | batch(spark, models, b)
    assert named(run(spark, tmp_path, models, parts)) == want


def test_a_quiet_time_ends_the_history_wherever_batches_end(spark, tmp_path, models):
    stamp = "2024-01-01 {:02d}:{:02d}:00 INFO step {}"
    early = [("a", i, stamp.format(0, i, i % 3)) for i in range(1, 9)]
    late = [("a", i, stamp.format(9, i, i % 3)) for i in range(9, 17)]
    steady = [("b", i, stamp.format(i // 2, 30 * (i % 2), i % 3)) for i in range(1, 17)]
    want = batch(spark, models, early) | batch(spark, models, late) | batch(spark, models, steady)
    for name, parts in (("one", [early + late + steady]), ("three", [early[:5] + steady[:3], early[5:] + late[:2] + steady[3:9], late[2:] + steady[9:]])):
        (tmp_path / name).mkdir()
        assert named(run(spark, tmp_path / name, models, parts, forget_after=3600.0, late="2 days")) == want


def test_states_of_quiet_streams_are_dropped(spark, tmp_path, models):
    line = "2024-01-{:02d} 00:00:00 INFO step 1"
    parts = [[("a", 1, line.format(1)), ("b", 1, line.format(1))], [("b", 2, line.format(9))], [("b", 3, line.format(10))], [("b", 4, line.format(11))]]
    run(spark, tmp_path, models, parts, forget_after=3600.0, late="1 hour")
    for name in ("keyed", "results"):
        state = spark.read.format("statestore").load(str(tmp_path / "d" / f"{name}-offsets"))
        assert {r.s for r in state.select(F.col("key.stream_id").alias("s")).collect()} == {"b"}


def test_segments():
    assert list(segments([0, None, 5_000_000], [False] * 3, None, 3.0)) == [(0, 2, False), (2, 3, True)]
    assert list(segments([1, 2, 3], [False, True, False], 0, None)) == [(0, 1, False), (1, 3, True)]
    assert list(segments([], [], 0, 1.0)) == []


def test_a_stream_has_one_state_however_many_templates_it_has(spark, tmp_path, models):
    data = text_lines(40, 1, "a") + text_lines(40, 2, "b")
    rows = run(spark, tmp_path, models, [data[:20] + data[40:60], data[20:40] + data[60:]])
    assert len({r.log_key for r in rows}) > 1 and named(rows) == batch(spark, models, data)
    state = spark.read.format("statestore").load(str(tmp_path / "d" / "results-offsets"))
    assert sorted(r.s for r in state.select(F.col("key.stream_id").alias("s")).collect()) == ["a", "b"]


class Held:
    """A group's state outside a stream."""

    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_group_comes_and_goes_as_two_columns(models, tmp_path):
    detector = StreamDetector(*models, str(tmp_path))
    remember, held = detector._history(), Held()
    first = pd.DataFrame({"stream_id": "a", "line": ["2\t3000000\t1\tfalse\t[7.0]\t+b\tc", "1\t1000000\t0\tfalse\t[]\t+a", "2\t\t5\tfalse\t\t"]})
    then = pd.DataFrame({"stream_id": "a", "line": ["3\t\t2\tfalse\t[1.5]\t+a", "4\t4000000\t3\tfalse\t[]\t+a", "1\t5\t0\tfalse\t[]\t+a"]})
    (got,) = remember(("a",), iter([first]), held)
    assert list(got.columns) == ["stream_id", "line"] and set(got["stream_id"]) == {"a"}
    assert got["line"].tolist() == [
        "1\t1000000\t0\t\t\t1\tfalse\t[]\t+a", "2\t3000000\t1\t2.0\t\t1\tfalse\t[7.0]\t+b\tc", "2\t\t5\t\t\t\ttrue\t\t",
    ]
    (got,) = remember(("a",), iter([then]), held)
    assert got["line"].tolist() == [
        "3\t\t2\t\t\t1\tfalse\t[1.5]\t+a", "4\t4000000\t3\t1.0\t[0,1,2]\t1\tfalse\t[]\t+a", "1\t5\t0\t\t\t\ttrue\t[]\t+a",
    ]
    follow, held = detector._previous(), Held()
    rows = pd.DataFrame({"stream_id": None, "line": ["9\ttrue\t1\tfalse\tfalse\t[2.5]\t+a", "8\ttrue\t1\tfalse\tfalse\t[1.5]\t+a", "7\tfalse\t\ttrue\tfalse\t\t"]})
    (got,) = follow((None,), iter([rows]), held)
    assert got["line"].tolist() == ["0\t\t7\ttrue\tfalse\t\t", "1\t\t8\tfalse\tfalse\t[1.5]\t+a", "2\t[1.5]\t9\tfalse\tfalse\t[2.5]\t+a"]
    assert list(got["stream_id"]) == [None] * 3


def test_rows_as_lines_keep_every_value(spark):
    schema = "n bigint, yes boolean, x double, ids array<bigint>, values array<double>, log_key string"
    rows = [
        (1, True, 1e-7, [3, 4], [0.1, float("inf"), 1e300, -0.0, None], "+a\tb\n\u20ac"), (None, None, None, None, None, None),
        (-5, False, 123456789.123, [], [], ""), (2**62, None, float("nan"), [0], [1 / 3], "\t"),
    ]
    given = spark.createDataFrame([("s", *row) for row in rows], f"stream_id string, {schema}")
    back = from_lines(given.select("stream_id", as_line(schema).alias("line")), schema)
    assert [f.dataType for f in back.schema] == [f.dataType for f in given.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, given.collect()))


def test_lines_with_tabs_and_without_text(spark, tmp_path, models):
    data = text_lines(30, 1, "a")
    data[4:7] = [("a", 5, "2024-01-01 00:00:00\tINFO +one\ttwo\n3", ), ("a", 6, ""), ("a", 7, None)]
    assert named(run(spark, tmp_path, models, [data[:6], data[6:]])) == batch(spark, models, data)


def test_a_detector_is_trained_on_the_lines_already_numbered(spark, monkeypatch):
    lines = spark.createDataFrame(text_lines(40, 1, "a"), "stream_id string, seq bigint, raw string").withColumn("event_type", F.lit("x"))
    monkeypatch.setattr(stream_queries.views, "app_lines", None)  # not numbered again
    assert stream_queries._detector(spark, "nowhere", lines).key_model.vocab.count() > 1
    assert stream_queries._app_pieces(lines).select("piece").distinct().count() == stream_queries.PIECES
