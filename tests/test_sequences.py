import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.operators import joins, keys, params
from siftline.operators.sequences import dense_position, last_known, lowest_before, previous, range_position, running_sum, windowed


def frame(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, length in (("hot", n), ("cold", 7), ("one", 1)):
        for i in range(1, length + 1):
            rows.append((s, i, rng.choice("abc"), rng.choice([None, float(i)]), rng.randrange(-2, 3)))
    return spark.createDataFrame(rows, "g string, pos bigint, k string, v double, x bigint").repartition(5)


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select("g", "pos", *columns).collect())


def test_chunked_windows_equal_plain_windows(spark):
    df = frame(spark)
    whole = Window.partitionBy("g").orderBy("pos")
    plain = df.withColumns(
        {"h": previous("k", 3)(whole), "n": F.lead("k", 2).over(whole), "s": F.sum("x").over(whole),
         "l": F.last("v", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)),
         "m": F.min("x").over(whole.rowsBetween(Window.unboundedPreceding, -1))}
    )
    for chunk in (1, 4, 9, 1000):
        got = windowed(df, ["g"], "pos", {"h": previous("k", 3), "n": lambda w: F.lead("k", 2).over(w)}, 3, 2, chunk)
        assert rows(got, "h", "n") == rows(plain, "h", "n")
        assert rows(running_sum(df, ["g"], "pos", F.col("x"), "s", chunk), "s") == rows(plain, "s")
        assert rows(last_known(df, ["g"], "pos", "v", "l", chunk), "l") == rows(plain, "l")
        assert rows(lowest_before(df, ["g"], "pos", "x", "m", chunk), "m") == rows(plain, "m")


def test_dense_position(spark):
    df = frame(spark).withColumn("t", F.col("pos") * 3)
    got = dense_position(df, ["g"], ["t"], F.floor(F.col("t") / 10), "r", total="n")
    assert all(r.r == r.pos for r in got.collect())
    assert {(r.g, r.n) for r in got.collect()} == {("hot", 200), ("cold", 7), ("one", 1)}


def test_windows_count(spark):
    df = frame(spark).select(F.col("g").alias("stream_id"), F.col("pos").alias("seq"), F.col("k").alias("log_key"))
    for w in (1, 3, 7, 300):
        n = keys.training_windows(df, w, chunk_rows=10).groupBy("stream_id").count().collect()
        assert {r.stream_id: r["count"] for r in n} == {s: c - w for s, c in (("hot", 200), ("cold", 7), ("one", 1)) if c > w}


def test_windows_of_numbers(spark):
    df = spark.createDataFrame([("s", i, str(i)) for i in range(1, 8)], "stream_id string, seq bigint, log_key string")
    got = [(r.hist, r.label) for r in keys.training_windows(df, 3, 2).orderBy("seq").collect()]
    assert got == [(["1", "2", "3"], "4"), (["2", "3", "4"], "5"), (["3", "4", "5"], "6"), (["4", "5", "6"], "7")]


def test_lookup_join_is_the_same_with_and_without_broadcast(spark):
    left = frame(spark)
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, y int")
    for how in ("left", "inner", "left_anti", "left_semi"):
        wide = joins.lookup(left, right, ["k"], how)
        columns = ["k", "y"] if "y" in wide.columns else ["k"]
        want = rows(wide, *columns)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert rows(joins.lookup(left, right, ["k"], how), *columns) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_previous_vectors_per_template(spark):
    df = spark.createDataFrame(
        [("s", i, "ab"[i % 2], [float(i)]) for i in range(1, 30)], "stream_id string, seq bigint, log_key string, params array<double>"
    )
    for chunk in (3, 100):
        got = params.with_previous(df, chunk).collect()
        assert all((r.prev == [r.params[0] - 2]) == (r.seq > 2) and r.nth == (r.seq + r.seq % 2) // 2 for r in got)


def test_range_position_spreads_names_that_begin_alike(spark):
    names = spark.range(20_000).select(F.concat(F.lit("x" * 60), F.lpad(((F.col("id") * 7919) % 20_000).cast("string"), 6, "0")).alias("name"))
    found = range_position(names.repartition(7), ["name"], "n")
    assert found.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (0, 19_999, 20_000)
    assert found.filter(F.col("n") != F.substring("name", 61, 6).cast("bigint")).isEmpty()
    assert range_position(names.limit(0), ["name"], "n").count() == 0
