import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import toxicity
from siftline.llm.toxicity import RUN, fit, marginals, score

from . import edge

SF = "/root/testdata/sf0.1"


def test_marginals_equal_sums_over_all_taggings():
    rng = np.random.default_rng(3)
    length = 7
    emit, there = np.zeros((2, RUN)), np.zeros((2, RUN), bool)
    there[0, :length] = there[1, :3] = True
    emit[there] = rng.normal(size=there.sum())
    move, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    chance, moves = marginals(emit, there, move, begin, np.array([1.0, 2.0]))
    want_moves = np.zeros((2, 2))
    for run, weight in ((0, 1.0), (1, 2.0)):
        n = int(there[run].sum())
        total, hits, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            x = begin[tags[0]] + sum(emit[run, i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(x)
            hits += np.exp(x) * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += np.exp(x)
        assert np.allclose(chance[run, :n], hits / total)
        want_moves += weight * pairs / total
    assert np.allclose(moves, want_moves)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    assert labels.where(held).first().doc_id is not None and zlib.crc32(b"1") % 4 != 2
    field = fit(docs, labels.where(~held))
    rows = score(docs.select("doc_id", "text"), field).join(labels.where(held), "doc_id").select("toxic", "score", "spans", "text").collect()
    toxic = [r.score >= 0.3 for r in rows if r.toxic]
    clean = [r.score >= 0.3 for r in rows if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.08 * len(clean)
    words = [r.text.encode()[s.start : s.end].decode().lower() for r in rows if r.toxic for s in r.spans]
    assert sum(w in {"idiot", "moron", "clown", "scum", "trash", "loser", "stupid", "pathetic", "worthless", "disgusting"} for w in words) > 0.3 * len(words)


def test_edges(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 1), (99, 1), (7, 0), (7, 0)], "doc_id bigint, toxic int")
    field = fit(docs, labels)
    for model in (field, fit(docs, labels.where("toxic = 1")), fit(edge.empty(spark), labels)):
        out = score(docs, model)
        assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert score(edge.empty(spark), field).count() == 0


def test_words_of_any_run_are_scored(spark):
    docs = spark.createDataFrame([(i, ("good word " * 100) + ("vile " if i % 2 else "fine ") + "other " * i) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    out = score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) for r in out)
    assert all(r.text.encode()[s.start : s.end] == b"vile" for r in out for s in r.spans)
