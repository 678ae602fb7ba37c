import random

import numpy as np
import pytest

from siftline.llm.graph import components
from siftline.llm.jaccard import linked, near_duplicates, one_per_group, overlap_bound

from . import edge


def shingles(text, words=5):
    w = edge.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_copies(rng, families=6, copies=9, length=60):
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(length)] = f"e{rng.randrange(9)}"
            text = text[: length - rng.randrange(12)] + [f"t{rng.randrange(99)}" for _ in range(rng.randrange(8))]
            rows.append((rng.randrange(10**6), " ".join(text)))
    return rows


@pytest.mark.parametrize(("chunk_bytes", "exhaustive_at"), [(500, 0.0), (1 << 20, 8.0)])
def test_equals_brute_force(spark, chunk_bytes, exhaustive_at):
    rows = near_copies(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(near_duplicates(docs, chunk_bytes=chunk_bytes, exhaustive_at=exhaustive_at)) == brute(rows)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert got(near_duplicates(edge.documents(spark))) == brute(rows)
    assert near_duplicates(edge.empty(spark)).count() == 0


def test_one_per_group_keeps_clean_documents(spark):
    docs = edge.documents(spark)
    out = one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11]
    assert out.where("doc_id is null").count() == 2


def test_one_per_group_with_clashing_and_missing_ids(spark):
    text = lambda tag, n=30: " ".join(f"{tag}{i}" for i in range(n))
    rows = [
        (1, text("a"), "x"), (1, text("b"), "x"),  # one id, two unlinked texts
        (2, text("b") + " end", "x"), (None, text("a") + " end", "x"),  # near copies of them
        (3, text("c"), "q"), (3, text("c"), "p"), (None, text("d"), "x"), (None, text("d"), "x"), (None, text("d") + " end", "x"),
        (None, "", "x"), (None, None, "x"), (4, None, "x"), (5, "", "x"), (5, "", "x"),
    ]
    out = one_per_group(spark.createDataFrame(rows, "doc_id bigint, text string, digest string"))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    nameless = [r for r in got if r[0] is None and r[1]]
    assert len(nameless) == 1 and nameless[0][1].startswith("d0")
    want = [(1, text("a"), "x"), (1, text("b"), "x"), (3, text("c"), "p"), (None, "", "x"), (None, None, "x"), (4, None, "x"), (5, "", "x")]
    assert [r for r in got if r not in nameless] == sorted(want, key=repr)


def test_suffix_filter_never_underestimates():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert overlap_bound(a, b, 3) >= common
        assert linked(a, b, 80) == (100 * common >= 80 * (len(a) + len(b) - common))


def test_components_of_a_long_path(spark):
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901"), ("902", "900"), ("901", "902")]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {found[f"{i:03d}"] for i in range(41)} == {"000"} and {found[x] for x in ("900", "901", "902")} == {"900"}
