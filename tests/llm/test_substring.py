import random

import pytest

from siftline.llm.substring import drop_repeated, without_repeats

from . import edge


def brute(rows, length):
    first = {}
    for i, text in rows:
        w = edge.words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, text in rows:
        w, gone = edge.words(text), set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (float("inf") if i is None else i):
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 20])
def test_equals_brute_force(spark, chunk_bytes):
    rng = random.Random(5)
    passages = [" ".join(rng.choices("abcdefg", k=9)) for _ in range(4)]
    rows = [(rng.randrange(40), "  ".join(rng.choice([*passages, "\n".join(rng.choices("abcdefgh", k=rng.randrange(6)))]) for _ in range(4))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(drop_repeated(docs, length=5, chunk_bytes=chunk_bytes)) == brute(rows, 5)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert got(drop_repeated(edge.documents(spark), length=5)) == brute(rows, 5)
    assert drop_repeated(edge.empty(spark)).count() == 0


def test_negative_ids(spark):
    rows = [(-5, "a b c d"), (3, "a b c d"), (-9, "x a b c d")]
    assert got(drop_repeated(spark.createDataFrame(rows, "doc_id bigint, text string"), length=4)) == brute(rows, 4)


def test_columns_stay(spark):
    docs = edge.documents(spark)
    out = without_repeats(docs, length=5)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] == " \n\t " and texts[2] == "" and texts[3] is None
