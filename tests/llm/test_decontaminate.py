import random

from siftline.llm.decontaminate import find_leaks, without_leaks

from . import edge

SF = "/root/testdata/sf0.001"


def distance(item, text):
    """The least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefgh ")
        elif kind == 1 and len(out) > 20:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdefgh "))
    return "".join(out)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(41, 90)))) for i in range(12)]
    rows = []
    for d in range(150):
        _, item = rng.choice(items)
        before, after = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) for _ in range(2))
        rows.append((d, before + edited(rng, item, rng.randrange(14)) + after))
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, m.item_id): m.distance for r in find_leaks(docs, table, block_bytes=200).collect() for m in r.matches}
    want = {}
    for d, text in rows:
        for i, item in items:
            budget = min(len(item) // 10, (len(item) - 8) // 8)
            if (least := distance(item.replace("\n", " "), text)) <= budget:
                want[d, i] = least
    assert got == want


def test_given_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    got = {(r.doc_id, m.item_id) for r in find_leaks(docs, items).collect() for m in r.matches}
    assert exact and exact <= got and len(got - exact) <= 2
    clean = {r.doc_id for r in without_leaks(docs, items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_places_are_bytes_of_the_text(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away."
    text = "日本 é\n" + item.upper().replace(" ", "\t") + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (m,) = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).first().matches
    assert text.encode()[m.start : m.end].decode().lower().replace("\t", " ") == item.lower() and m.distance == 0


def test_edges(spark):
    docs = edge.documents(spark)
    items = spark.createDataFrame([(1, None), (None, "x" * 60), (2, ""), (3, "short"), (4, edge.LONG[5000:5300]), (4, edge.LONG[5000:5300])], "item_id bigint, text string")
    out = find_leaks(docs, items)
    assert out.count() == docs.count()
    assert {r.doc_id for r in out.collect() if r.matches} == {7, 8}
    assert without_leaks(docs, items).columns == docs.columns
    none = items.where("item_id = 99")
    assert without_leaks(docs, none).count() == docs.count() and find_leaks(edge.empty(spark), items).count() == 0
