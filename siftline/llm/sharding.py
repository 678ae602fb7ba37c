"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child draws a number from the row's key and
the child's own name, divided by the child's weight; the smallest draw wins. A node weighs as much as all shards below it, so
each shard gets its share. A draw depends on nothing but key, name and weight: when a weight changes, rows move only within,
into or out of the subtree whose weight changed. Everything is column expressions; nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import materialize

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

MAX_NODES = 5000
ROWS_AT_ONCE = 100_000


def even_tree(shards: int = 16, regions: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Equal shards dealt over regions and racks."""
    tree: dict = {}
    per_rack = -(-shards // (regions * racks))
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """The tree with one more shard in a region of its own: no other node's weight changes, so rows move only into the new shard."""
    return {**tree, f"region{len(tree)}": {"rack0": {shard: weight}}}


def children(names_weights: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in names_weights if w > 0])


def draw(key: Column, nodes: Column) -> Column:
    """The name of the child with the smallest weighted draw; equal draws go to the smaller name."""

    def scored(child: Column) -> Column:
        part = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.ln(part) / child["weight"]).alias("score"), child["name"].alias("name"))

    return F.array_min(F.transform(nodes, scored))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key as an expression."""
    weight = {r: {k: sum(shards.values()) for k, shards in racks.items()} for r, racks in tree.items()}
    if sum(len(shards) for racks in tree.values() for shards in racks.values()) > MAX_NODES:
        raise ValueError(f"a tree of more than {MAX_NODES} shards doesn't belong in an expression")
    regions = children([(r, sum(racks.values())) for r, racks in weight.items()])
    racks_of = F.create_map(*[x for r, racks in weight.items() for x in (
        F.lit(r), children([(f"{r}/{k}", w) for k, w in racks.items()]))])
    shards_of = F.create_map(*[x for r, racks in tree.items() for k, shards in racks.items() for x in (
        F.lit(f"{r}/{k}"), children([(f"{r}/{k}/{s}", w) for s, w in shards.items()]))])
    region = draw(key, regions)
    rack = draw(key, F.element_at(racks_of, region))
    return F.element_at(F.split(draw(key, F.element_at(shards_of, rack)), "/"), -1).cast("int")


def place(df: DataFrame, tree: Tree, key: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """Add the shard of every row; a column of that name is replaced, other columns stay.

    The key alone decides: rows with equal keys share a shard, and rows without a key share the one of the empty key.
    """
    return df.withColumn(shard_col, shard_of(F.col(key), tree))


def number(df: DataFrame, columns: list[str], shard_col: str = "shard", slot_col: str = "slot", digits: int = 4) -> DataFrame:
    """Each row's ``columns`` and shard, with a slot in its shard, from 0 without gaps.

    Equal rows are first counted as one group, so a row that is repeated any number of times is one group with a run of slots.
    Groups are dealt to 16**``digits`` buckets per shard by a hash; slots run over the buckets, and within one by
    the columns' values. No task sees more than one bucket of one shard.
    """
    keys = [F.col(c) for c in columns]
    bucket = F.substring(F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in keys])), 1, digits)
    groups = df.groupBy(shard_col, *columns).agg(F.count(F.lit(1)).alias("copies__")).withColumn("bucket__", bucket)
    groups = materialize(groups, "shard-groups")
    sizes = groups.groupBy(shard_col, "bucket__").agg(F.sum("copies__").alias("rows__"))
    before = Window.partitionBy(shard_col).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard_col, "bucket__", F.coalesce(F.sum("rows__").over(before), F.lit(0)).alias("offset__"))
    inside = Window.partitionBy(shard_col, "bucket__").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = groups.join(offsets, [shard_col, "bucket__"]).withColumn(
        "start__", F.col("offset__") + F.coalesce(F.sum("copies__").over(inside), F.lit(0))
    )
    parts = F.sequence(F.lit(0).cast("bigint"), F.col("copies__") - 1, F.lit(ROWS_AT_ONCE).cast("bigint"))
    runs = numbered.withColumn("part__", F.explode(parts))
    last = F.least(F.col("copies__"), F.col("part__") + ROWS_AT_ONCE) - 1
    return runs.withColumn("copy__", F.explode(F.sequence("part__", last))).select(
        *columns, shard_col, (F.col("start__") + F.col("copy__")).alias(slot_col)
    )


def assign(docs: DataFrame, tree: Tree, more: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's bytes plus one, and a null text has none; ``grown_shard`` is the shard in the tree ``more``. Documents of equal id
    share a shard; repeated rows get slots of their own; an empty table gives an empty result. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place(rows, tree, id_col)
    return number(placed, [id_col, "size", "text_crc32"]).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col(id_col), more).alias("grown_shard")
    )
