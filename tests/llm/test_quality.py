import random
import re
from collections import Counter

from siftline.llm.quality import fit, judge, keep_good, quality, text_stats

from . import edge

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = edge.words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if edge.words(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(cover)


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["a", "b", "é", "日本", "#", "|", " ", " ", "\n", "\n", "\t", "\r", "x y", "\x1c"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(300)]
    for row in text_stats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert counts(row) == brute(row.text), repr(row.text)


def test_verdict_follows_labels_it_never_saw(spark):
    found = quality(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label")
    rows = found.join(labels, "doc_id").where("n_words >= 50").select("label", "kept").collect()
    good = [r.kept for r in rows if r.label == 1]
    bad = [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_posterior_of_rules_that_agree(spark):
    stats = text_stats(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    model = fit(stats)
    assert 0.7 < model.prior < 0.98
    worst = max(model.posterior, key=lambda p: p.count("b"))
    assert model.posterior[worst] < 0.01 and max(model.posterior.values()) > 0.99
    assert judge(stats, model).where("base_failed and kept").count() == 0


def test_edges(spark):
    docs = edge.documents(spark)
    found = quality(docs)
    assert found.count() == docs.count()
    for row in found.collect():
        assert counts(row) == brute(row.text)
        if row.n_words < 50:
            assert row.base_failed and not row.kept
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {7, 8}
    assert quality(edge.empty(spark)).count() == 0 and keep_good(edge.empty(spark)).count() == 0
