from pyspark.sql import functions as F

from siftline.llm.token_counts import CHANGE, TokenRollup, deleted, inserted, piece_count, revised, word_count

from . import edge


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=repr)


def test_signed_changes_and_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", 10), (2, "s", "en", 5), (3, None, "de", 7)], "doc_id bigint, source string, lang string, n bigint")
    rollup = TokenRollup(spark, str(tmp_path))
    assert totals(rollup) == []
    rollup.commit("a", inserted(docs, "v1", F.col("n")))
    rollup.commit("a", inserted(docs, "v1", F.col("n")))
    assert totals(rollup) == sorted([("s", "en", "v1", 2, 15), (None, "de", "v1", 1, 7)], key=repr)
    rollup.commit("b", revised(docs.where("doc_id = 1"), "v1", F.col("n"), F.lit(4)))
    rollup.compact()
    rollup.commit("b", revised(docs.where("doc_id = 1"), "v1", F.col("n"), F.lit(4)))
    rollup.commit("c", deleted(docs.where("doc_id = 3"), "v1", F.col("n")))
    assert totals(rollup) == [("s", "en", "v1", 2, 9)]
    rollup.compact()
    rollup.commit("a", inserted(docs, "v1", F.col("n")))
    assert totals(TokenRollup(spark, str(tmp_path))) == [("s", "en", "v1", 2, 9)]


def test_an_attempt_that_was_not_committed_counts_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    lost = spark.createDataFrame([("dead", "s", "en", "v1", 1, 99)], rollup.read("deltas", "attempt string, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint").schema)
    lost.write.mode("append").parquet(f"{rollup.path}/deltas")
    assert totals(rollup) == []


def test_edges(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    rollup.commit("none", spark.createDataFrame([], CHANGE))
    rows = [("x", None, None, None, None, 3), ("x", None, None, None, None, 3), (None, "s", "l", "t", None, 2), (None, "s", "l", "t", None, 2), ("y", "s", "l", "t", None, None)]
    rollup.commit("nulls", spark.createDataFrame(rows, CHANGE).withColumn("n_docs", F.lit("clash")).withColumn("attempt", F.lit(1)))
    assert totals(rollup) == sorted([(None, None, None, 1, 3), ("s", "l", "t", 2, 4)], key=repr)
    docs = edge.documents(spark).withColumn("w", word_count(F.col("text"))).withColumn("p", piece_count(F.col("text")))
    assert all(r.w == len(edge.words(r.text)) and r.p >= r.w for r in docs.collect())
    rollup.commit("docs", inserted(edge.documents(spark), "w", word_count(F.col("text"))))
    distinct = {(r[0], len(edge.words(r[1]))) for r in edge.rows() if r[0] is not None}
    added = {r.tokenizer: 0 for r in rollup.totals().collect()}
    assert "w" in added and sum(n for _, n in distinct) <= sum(r.n_tokens for r in rollup.totals().where("tokenizer = 'w'").collect())


def counted(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, source string, lang string, n bigint")


def test_documents_without_id_all_count(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    docs = counted(spark, (None, "s", "en", 5), (None, "s", "en", 5), (None, "s", "en", 7), (1, "s", "en", 2), (1, "s", "en", 2))
    rollup.commit("a", inserted(docs, "v1", F.col("n")))
    assert totals(rollup) == [("s", "en", "v1", 4, 19)]


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup, other = TokenRollup(spark, str(tmp_path)), TokenRollup(spark, str(tmp_path))
    rollup.commit("a", inserted(counted(spark, (1, "s", "en", 10)), "v1", F.col("n")))
    plain = rollup.sums

    def meanwhile(standing):
        other.commit("b", inserted(counted(spark, (2, "s", "en", 5)), "v1", F.col("n")))
        return plain(standing)

    monkeypatch.setattr(rollup, "sums", meanwhile)
    rollup.compact()
    assert totals(other) == [("s", "en", "v1", 2, 15)]
    other.compact()
    assert totals(other) == [("s", "en", "v1", 2, 15)]
    other.commit("b", inserted(counted(spark, (2, "s", "en", 5)), "v1", F.col("n")))
    assert totals(other) == [("s", "en", "v1", 2, 15)]


def test_first_commit_in_the_folder_wins(spark, tmp_path, monkeypatch):
    import time

    rollup = TokenRollup(spark, str(tmp_path))
    rollup.commit("a", inserted(counted(spark, (1, "s", "en", 10)), "v1", F.col("n")))
    monkeypatch.setattr(time, "time_ns", lambda: 0)  # a driver whose clock is behind
    rollup.commit("a", inserted(counted(spark, (1, "s", "en", 15)), "v1", F.col("n")))
    assert totals(rollup) == [("s", "en", "v1", 1, 10)]
    # two drivers that both found the batch new: the later file loses
    other = spark.createDataFrame([("s", "en", "v1", 1, 99)], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
    time.sleep(0.05)
    rollup.append(other, "a", None)
    assert totals(rollup) == [("s", "en", "v1", 1, 10)]
