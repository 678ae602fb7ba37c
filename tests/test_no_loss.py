"""Input that must not get lost: splits that move between scans, part folders, folder names with dots, long rule tables."""

import os

from siftline.operators import match
from siftline.plans import stream_queries, views
from siftline.sources import text as src


def test_line_numbers_when_splits_move(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(1, 20_001)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        lines = src.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70001")
        found = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(found) == 20_000 and all(r.raw == f"line {r.seq}" for r in found)


def test_folder_name_with_a_dot(spark, tmp_path):
    folder = tmp_path / "2024.01.02"
    folder.mkdir()
    (folder / "a.log").write_text("one\n")
    (folder / "b.tmp").write_text("not a log\n")
    assert [r.raw for r in src.read_tree(spark, str(folder)).collect()] == ["one"]
    assert [r.raw for r in src.read_tree(spark, str(folder / "b.tmp")).collect()] == ["not a log"]


def test_no_bounds_by_default(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02d}.log").write_text("x\n" * 200)
    assert src.read_capped(spark, str(tmp_path)).count() == 2400
    capped = src.read_capped(spark, str(tmp_path), max_files=2, max_lines=300).collect()
    assert len(capped) == 300 and {os.path.basename(r.stream_id) for r in capped} == {"f00.log", "f01.log"}


def test_balanced_above_a_thousand_rows(spark):
    lines = spark.range(9000).selectExpr("concat('s', id % 3) AS stream_id", "id AS seq", "if(id < 2500, 'a', 'b') AS kind")
    found = src.balanced(lines, "kind", 2000).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in found} == {"a": 2000, "b": 2000}
    smallest = src.balanced(lines, "kind").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in smallest} == {"a": 2500, "b": 2500}


def test_rule_table_longer_than_a_slice(spark, lines, monkeypatch):
    monkeypatch.setattr(match, "RULE_SLICE", 3)
    rules = spark.createDataFrame([(f"r{i}", f"word{i}x") for i in range(10)], "rule_id string, pattern string")
    found = match.match_dynamic(lines("word1x word9x", "word4x", "none"), rules).collect()
    assert sorted((r.seq, r.rule_id) for r in found) == [(1, "r1"), (1, "r9"), (2, "r4")]
    assert match.match_dynamic(lines("word1x"), rules.limit(0)).count() == 0


def test_streams_read_folders_of_part_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = stream_queries._event_stream(spark, str(tmp_path), views.EVENT_COLUMNS)
    out = tmp_path / "out"
    stream_queries._finish(stream.writeStream.format("parquet").option("path", str(out)), str(tmp_path / "work"))
    assert spark.read.parquet(str(out)).count() == events.count()
