import datetime
import json

from pyspark.sql import functions as F

from siftline import sinks
from siftline.sources import files, flows
from siftline.sources import text as src


def test_lines_have_numbers_and_no_blanks_or_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  two \xff\xfe\n# note\nthree\n")
    (tmp_path / "b.txt").write_text("x\n")
    (tmp_path / "c.dat").write_text("no\n")
    got = src.read_directory(spark, str(tmp_path)).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id[-5:], r.seq, r.raw) for r in got] == [
        ("a.log", 1, "one"), ("a.log", 3, "two"), ("a.log", 4, "# note"), ("a.log", 5, "three"), ("b.txt", 1, "x")
    ]
    assert src.read_lines(spark, str(tmp_path / "a.log"), max_lines=3).count() == 2
    assert src.read_lines(spark, str(tmp_path / "a.log"), skip_comments=True).count() == 3
    again = src.renumber(src.read_lines(spark, str(tmp_path / "a.log"))).orderBy("seq").collect()
    assert [r.seq for r in again] == [1, 2, 3, 4]


def test_numbers_are_dense_over_many_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = src.read_lines(spark, str(tmp_path / "big.log"))
        assert lines.rdd.getNumPartitions() > 4
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r.raw == f"line {r.seq}" for r in rows)


def test_tree_auto_balanced_and_capped(spark, tmp_path):
    for name, content in (
        ("linux_logs/auth.log", "Jan 5 a\n" * 5), ("windows_logs/e.txt", "x EventID=1\n" * 3), ("my_apache/sub/x.log", "GET / HTTP/1.1\n" * 9), ("other/u.log", "?\n"),
    ):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    assert src.read_tree(spark, str(tmp_path)).count() == 15
    assert src.read_tree(spark, str(tmp_path / "other/u.log")).count() == 1
    kinds = {(r.log_type, r.n) for r in src.read_auto(spark, str(tmp_path)).groupBy("log_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("linux", 5), ("windows", 3), ("nginx", 9)}
    sample = src.read_balanced(spark, str(tmp_path), max_logs=12, seed=1).groupBy("log_type").count().collect()
    assert {r.log_type: r["count"] for r in sample} == {"linux": 4, "windows": 3, "apache": 4}
    assert src.read_capped(spark, str(tmp_path), max_files=2, max_lines=7).count() == 7
    unified = src.with_type(src.read_lines(spark, str(tmp_path / "other/u.log")), unified=True)
    assert unified.first().log_type == "linux"


def test_labels_and_splits(spark, lines):
    got = src.split_label(lines("- ok line", "FATAL 1 bad", "alone")).orderBy("seq").collect()
    assert [(r.label, r.raw) for r in got] == [("-", "ok line"), ("FATAL", "1 bad"), ("-", "alone")]
    df = lines(*[f"l{i}" for i in range(10)])
    assert src.positional_split(df).filter("part = 'train'").count() == 8
    assert sorted(r.seq for r in src.tail(df, 3).collect()) == [8, 9, 10]
    assert sorted(r.seq for r in src.head(df, 2).collect()) == [1, 2]


def test_dates_keep_lines_without_time(spark, lines):
    df = lines("Jan 05 10:00:00 h a", "2024-01-06T10:00:00 b", "2024-01-07 00:00:00 c", "no time", "Jan 08 00:00:00 h d")
    ts = src.linux_line_time(F.col("raw"), 2024)
    day = datetime.date
    assert sorted(r.seq for r in src.in_dates(df, ts, day(2024, 1, 6), day(2024, 1, 7)).collect()) == [2, 3, 4]
    access = lines('1.1.1.1 - - [05/Jan/2024:23:59:59 +0000] "x"', '1.1.1.1 - - [06/Jan/2024:00:00:00 +0000] "x"')
    assert [r.seq for r in src.in_dates(access, src.access_line_day(F.col("raw")), None, day(2024, 1, 5)).collect()] == [1]


def test_the_time_of_a_line_is_read_once_and_after_dealing(lines):
    access = lines('1.1.1.1 - - [05/Jan/2024:23:59:59 +0000] "x"', '1.1.1.1 - - [09/Jan/2024:00:00:00 +0000] "x"', "no time")
    dealt = access.withColumn("raw", F.concat("raw", F.lit(" "))).repartition(3).withColumn("raw", F.upper("raw"))
    found = src.in_dates(dealt, src.access_line_day(F.col("raw")), datetime.date(2024, 1, 9), datetime.date(2024, 1, 9))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.index("regexp_extract") < plan.index("Repartition")
    assert found.columns == ["stream_id", "seq", "raw"] and {r.seq for r in found.collect()} >= {3}


def test_pasted_text(spark):
    df = spark.createDataFrame([("d", "a\n\n b \r\nc")], "id string, body string")
    assert [(r.seq, r.raw) for r in src.pasted(df, "body", "id").orderBy("seq").collect()] == [(1, "a"), (3, "b"), (4, "c")]


def test_files_and_flows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.php").write_text("a\nb")
    (tmp_path / "s" / "y.md").write_text("no")
    assert [r.content for r in files.read_files(spark, str(tmp_path), [".php"]).collect()] == ["a\nb"]
    values = ["0"] * 43
    values[1:6] = ["tcp", "http", "SF", "181", "5450"]
    values[41:] = ["normal", "21"]
    (tmp_path / "kdd.csv").write_text(",".join(values) + "\n")
    line = flows.read_nsl_kdd(spark, str(tmp_path / "kdd.csv")).select(flows.nsl_kdd_line().alias("x")).first().x
    assert line == "[TCP] http | SRC:181 DST:5450 | FLAG:SF | ATTACK:normal (difficulty:21)"
    (tmp_path / "unsw.csv").write_text("proto,service,spkts,dpkts,sbytes,dbytes,rate,state,attack_cat,label\nudp,-,2,0,496,0,90909.0902,INT,Normal,0\n")
    line = flows.read_unsw(spark, str(tmp_path / "unsw.csv")).select(flows.unsw_line().alias("x")).first().x
    assert line == "[UDP] - | SPKTS:2 DPKTS:0 | SBYTES:496 DBYTES:0 | RATE:90909.09 | STATE:INT | ATTACK:Normal LABEL:0"


def read(path):
    return [line for f in sorted(path.rglob("part-*")) for line in f.read_text().splitlines()]


def test_sinks(spark, lines, tmp_path):
    df = lines("a", "b", "c").withColumns(
        {"is_anomaly": F.col("seq") != 2, "anomaly_type": F.lit("path"), "label": F.when(F.col("seq") == 1, "-").otherwise("X")}
    )
    assert [r.value for r in sinks.anomaly_lines(df).collect()] == ["s line 1 [path] a", "s line 3 [path] c"]
    sinks.write_outcomes(df, str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o").glob("outcome=*")) == ["outcome=detected", "outcome=false_alarm", "outcome=missed"]
    sinks.export_lines(df, str(tmp_path / "e"))
    assert read(tmp_path / "e") == ["a", "b", "c"]
    totals = df.agg(F.count("*").alias("n"))
    body = json.loads(sinks.nested_report({"totals": totals, "rows": df.select("seq")}).first().value)
    assert body["totals"] == [{"n": 3}] and sorted(r["seq"] for r in body["rows"]) == [1, 2, 3]
    events = df.withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:00'"), "threat_level": F.lit("HIGH"), "attack_type": F.lit("xss"),
                             "source_ip": F.lit("1.1.1.1"), "timeline_order": F.col("seq")})
    advice = spark.createDataFrame([(0, "HIGH", "act")], "ord int, severity string, recommendation string")
    sinks.write_timeline_report(events, {"levels": totals}, advice, str(tmp_path / "t"))
    assert read(tmp_path / "t" / "timeline")[0] == "2024-01-01 00:00:00 [HIGH] xss 1.1.1.1 a"
    assert read(tmp_path / "t" / "advice") == ["[HIGH] act"]
    keys = spark.createDataFrame([("k", 2, True)], "log_key string, n bigint, unseen boolean")
    contexts = spark.createDataFrame([("a | b", 2)], "context string, n bigint")
    sinks.write_scan_summary(totals, keys, contexts, sinks.anomaly_lines(df, 1), str(tmp_path / "s"))
    assert read(tmp_path / "s" / "log_keys") == ["2\tk (unseen)"] and read(tmp_path / "s" / "counters") == ["n=3"]
    sinks.write_json(totals, str(tmp_path / "j"))
    assert read(tmp_path / "j") == ['{"n":3}']


def test_windows_export_line(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00.000", "Error", 4625, "two\r\nlines")], "t string, l string, e int, m string")
    got = df.select(src.windows_line(F.col("t"), F.col("l"), F.col("e"), F.col("m")).alias("x")).first().x
    assert got == "2024-01-01 10:00:00.000 Error EventID=4625 two lines"
