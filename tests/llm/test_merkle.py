import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftline.llm.merkle import fold, manifest, proof_digest

from . import edge

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, place string, digest string, steps string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(leaves, k):
    """The root, and each leaf's (before, after) steps."""
    nodes = [(d, [i]) for i, d in enumerate(leaves)]
    steps = [[] for _ in leaves]
    while len(nodes) > 1:
        parents = []
        for i in range(0, len(nodes), k):
            run = nodes[i : i + k]
            for j, (_, under) in enumerate(run):
                for leaf in under:
                    steps[leaf].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            parents.append((h("".join(d for d, _ in run)), [x for _, under in run for x in under]))
        nodes = parents
    return nodes[0][0], steps


def brute(rows, k=2):
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append((row[0], leaf_of(row)))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for name in names:
        ordered = sorted(parts[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        grown[name] = (ordered, *grow([d for _, d in ordered], k))
    root, upper = grow([grown[n][1] for n in names], k)
    out = []
    for n, up in zip(names, upper):
        ordered, subroot, steps = grown[n]
        for place, ((key, leaf), own) in enumerate(zip(ordered, steps)):
            proof = own + up
            out.append((n, key, place, leaf, subroot, root, h("".join(a + b for a, b in proof))))
    return sorted(out, key=str)


def found(docs, **how):
    rows = manifest(docs, **how).withColumn("proof", proof_digest(F.col("steps"))).withColumn("folded", fold(F.col("leaf"), F.col("steps"))).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted(((r.lang, r.doc_id, r.place, r.leaf, r.subroot, r.root, r.proof) for r in rows), key=str)


@pytest.mark.parametrize("arity, n", [(2, 1), (3, 2), (2, 9), (2, 61), (3, 61), (5, 61)])
def test_equals_brute_force(spark, arity, n):
    rows = [(i * 7 % 64, f"s{i % 3}", (None, "de", "é", "en", "a")[i % 5 if n > 9 else i % 2], None if i % 4 == 0 else i, "x" * (i % 5) if i % 6 else None) for i in range(n)]
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA).repartition(5)
    assert found(docs, arity=arity) == brute(rows, arity)


def test_ties_repeats_and_nulls(spark):
    docs = edge.documents(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert manifest(edge.empty(spark)).count() == 0


def test_a_row_repeated_many_times(spark):
    docs = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("bigint").alias("n_chars"), F.lit("t").alias("text"))
    rows = manifest(docs).collect()
    assert sorted(r.place for r in rows) == list(range(3000)) and len({r.root for r in rows}) == 1
    assert rows[0].root == grow([leaf_of((5, "s", "en", 1, "t"))] * 3000, 2)[0]


def test_claims_break_the_root_exactly_where_a_value_differs(spark):
    rows = [(i, "s", "en" if i % 3 else None, None if i % 5 == 0 else i, "t") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    for r in manifest(docs, claims=claims).withColumn("folded", fold(F.col("claimed_leaf"), F.col("steps"))).collect():
        bad = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id % 5 != 0
        i = r.doc_id
        assert (r.folded != r.root) == bad
        assert r.claimed_leaf == leaf_of((i, "s", "en" if i % 3 else None, None if i % 5 == 0 else i + bad, "t"))
