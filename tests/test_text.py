import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import keys, params


def one(spark, column, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(column(F.col("raw")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, key",
    [
        ("2024-01-01 10:00:00 INFO Starting application", "* *:*:* INFO Starting application"),
        ("INFO User login user_id=12345", "INFO User login **=*"),
        ("INFO Connection from 192.168.1.100", "INFO Connection from *"),
        ("INFO Request abcdefab-abcd-abcd-abcd-abcdefabcdef", "INFO Request *"),
        ("INFO Reading config from /etc/app/config.json", "INFO Reading config from /*"),
        ("info Starting application", "INFO Starting application"),
        ("Error Database connection failed", "ERROR Database connection failed"),
        ("no level here 5", "no level here *"),
        ("INFO=5 done", "*=* done"),
        ("", ""),
        ("  padded\t", "padded"),
        ("INFO größe=5", "INFO *=*"),
    ],
)
def test_template(spark, raw, key):
    assert one(spark, text.log_key, raw) == key


def test_template_of_long_lines(spark):
    assert len(one(spark, text.log_key, "INFO " + "A" * 300)) < 250
    assert one(spark, text.log_key, "B" * 300) == "B" * 200 + "..."
    kept = "EventID=42 " + "C" * 300
    assert one(spark, text.log_key, kept) == "*=* " + "C" * 196 + "..."
    event = "seen EventID: ERROR " + "D" * 300
    assert one(spark, text.log_key, "ERROR EventID:x " + "D" * 300).startswith("ERROR EventID:x DDD")
    assert one(spark, text.log_key, event).startswith("seen EventID: ")


def test_digits_do_not_change_the_template(spark):
    assert one(spark, text.log_key, "INFO job 1 took 2.5 s") == one(spark, text.log_key, "INFO job 77 took 9.125 s")


@pytest.mark.parametrize(
    "raw, values",
    [
        ("INFO User login user_id=12345", [12345.0]),
        ("INFO Request completed in 0.5 seconds", [0.5]),
        ("INFO Processing request request_id=req001 duration=2.5", [2.5]),
        ("INFO Connected to database mysql", []),
        ("INFO Starting application", []),
        ("2024-01-01 10:00:00 INFO took 3 ms for 7 of 99999999 and 10", [3.0, 7.0]),
        ("x_id=200000 y=0 z=5", [200000.0, 5.0]),
    ],
)
def test_parameters(spark, raw, values):
    assert one(spark, text.parameters, raw) == values


@pytest.mark.parametrize(
    "raw, ts",
    [
        ("at 2024-01-01 10:00:00 x", datetime.datetime(2024, 1, 1, 10)),
        ("2024-01-01  10:00:00.5 x", datetime.datetime(2024, 1, 1, 10)),
        ("2024/03/04 01:02:03 x", datetime.datetime(2024, 3, 4, 1, 2, 3)),
        ("2024-01-01 25:00:00 x", None),
        ("nothing", None),
    ],
)
def test_timestamp(spark, raw, ts):
    assert one(spark, text.timestamp, raw) == ts


def test_stream_identifier(spark):
    assert one(spark, text.stream_identifier, "read block_id: blk_7, ok") == "blk_7"
    assert one(spark, text.stream_identifier, "Instance ID i-9 up") == "i-9"
    assert one(spark, text.stream_identifier, "id 01234567-89ab-cdef-0123-456789abcdef") == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, text.stream_identifier, "plain") == "default"


def test_time_deltas_skip_lines_without_time(spark, lines):
    df = lines("2024-01-01 10:00:00 a", "no time", "2024-01-01 10:00:02 b", "2024-01-01 10:00:05 c")
    for chunk in (1, 2, 100):
        got = keys.with_time_delta(keys.parse_lines(df), chunk).orderBy("seq")
        assert [r.time_delta for r in got.collect()] == [None, None, 2.0, 3.0]
    assert [r.params for r in keys.parse_streams(df).orderBy("seq").collect()] == [[], [], [2.0], [3.0]]


def test_given_times_win(spark, lines):
    df = lines("2024-01-01 10:00:00 a").withColumn("t", F.expr("timestamp_ntz'2030-05-05 00:00:00'"))
    assert keys.parse_lines(df, "t").first().ts == datetime.datetime(2030, 5, 5)


def test_grouping_by_identifier(spark, lines):
    df = lines("session1: a", "session2: b", "session1: c", "session2: d")
    named = keys.by_identifier(df, F.split("raw", ":")[0], chunk_rows=1)
    assert sorted((r.stream_id, r.seq, r.raw[-1]) for r in named.collect()) == [
        ("session1", 1, "a"), ("session1", 2, "c"), ("session2", 1, "b"), ("session2", 2, "d")
    ]
    assert {r.stream_id for r in keys.by_identifier(df).collect()} == {"default"}


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4, 5], None), ([5], [0.0]), ([2, 2, 2], [0.0] * 3)])
def test_normalize(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.s for r in params.normalize(df, "v", "s").collect()]
    if want is None:
        assert abs(sum(got)) < 1e-9 and abs(sum(x * x for x in got) / len(got) - 1) < 1e-9
    else:
        assert got == want


def test_squared_error(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [1.0, 2.0, 4.0])], "a array<double>, b array<double>, c array<double>")
    row = df.select(*[params.squared_error(F.col("a"), F.col(x)).alias(x) for x in "abc"]).first()
    assert (row.a, row.b) == (0.0, 9.0) and abs(row.c - 1 / 3) < 1e-12


def test_vectors_are_padded_and_cut(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "p array<double>")
    row = df.select(*[params.fit_length(F.col("p"), F.lit(n)).alias(f"n{n}") for n in (1, 2, 4)]).first()
    assert list(row) == [[1.0], [1.0, 2.0], [1.0, 2.0, 0.0, 0.0]]
