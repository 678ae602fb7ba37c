import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm.sharding import MAX_NODES, assign, even_tree, grown, place, shard_of

from . import edge


def spark_hash(key, name):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(name.encode(), seed)


def brute(key, tree):
    def draw(nodes):
        return min((-math.log(((spark_hash(key, name) >> 11) + 0.5) / 2**53) / w, name) for name, w in nodes)[1]

    region = draw([(r, sum(sum(s.values()) for s in racks.values())) for r, racks in tree.items()])
    rack = draw([(f"{region}/{k}", sum(s.values())) for k, s in tree[region].items()])
    return int(draw([(f"{rack}/{s}", w) for s, w in tree[region][rack.split("/")[1]].items()]).split("/")[-1])


def test_equals_brute_force_and_grows_only_into_the_new_shard(spark):
    tree = even_tree(16)
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(-50, 1500)], "doc_id bigint, text string")
    rows = assign(docs, tree, grown(tree, 16)).collect()
    for r in rows:
        assert r.shard == brute(r.doc_id, tree) and r.grown_shard in (r.shard, 16) and r.law == "key"
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0.5 < moved / (len(rows) / 17) < 1.5
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 50


def test_a_changed_weight_moves_rows_only_inside_its_subtrees(spark):
    tree = even_tree(16)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["region0"]["rack1"][5] = 3.0
    rows = spark.range(4000).select("id", shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), heavier).alias("b")).where("a <> b").collect()
    assert rows
    for r in rows:
        if r.a // 4 == 1:  # inside the rack, rows move only to the heavier shard
            assert r.b == 5
        elif r.a < 8:  # from the region's other rack, only into the heavier rack
            assert 4 <= r.b < 8
        else:  # from the other region, only into the heavier region
            assert r.b < 8


def test_edges(spark):
    tree = even_tree(16)
    docs = edge.documents(spark)
    rows = assign(docs, tree, grown(tree, 16)).collect()
    texts = [r[1] for r in edge.rows()]
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert assign(edge.empty(spark), tree, grown(tree, 16)).count() == 0
    assert place(docs, {"r": {"k": {3: 1.0, 4: 0.0}}}).select("shard").distinct().collect()[0].shard == 3
    with pytest.raises(ValueError):
        shard_of(F.lit(1), {"r": {"k": {i: 1.0 for i in range(MAX_NODES + 1)}}})


def test_one_row_repeated_many_times(spark):
    docs = spark.range(250_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    tree = even_tree(4)
    out = assign(docs, tree, grown(tree, 4))
    found = out.agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    assert (found.n, found.d, found.a, found.b) == (250_000, 250_000, 0, 249_999)
