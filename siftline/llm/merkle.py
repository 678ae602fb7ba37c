"""Merkle manifest of a dataset: a tree of row digests per part, a tree over the parts' roots, and a proof for every row.

Nodes of a level are rows (tree, place, digest). A level joins its nodes with the siblings' computed places: the place with
its last bit flipped in a binary tree, every other slot of the run otherwise. Rows in slot zero then emit the parents. Every
level is a stored table, so a lost executor costs one level's tasks. Proofs go down the same levels: a node's proof is its own
siblings and then its parent's proof, so no level is joined with all rows but the lowest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import materialize

STEP = "struct<before:string,after:string>"
#: Levels that are joined on the way down before the proofs so far are stored.
LEVELS_AT_ONCE = 6


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def part_name(part: Column) -> Column:
    """A part's name in the order of trees: no part first, then by bytes."""
    return F.coalesce(F.concat(F.lit("v"), part.cast("string")), F.lit("n"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add place (from 0) and size within ``tree``, by ``order``.

    Rows are dealt by ranges and sorted inside them; a row's place is its number inside the range plus the sizes of the tree's
    earlier ranges. So a tree that holds most rows takes as many tasks as its size needs; equal rows are dealt apart as well.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    runs = dealt.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(
        "tree", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"),
    ), "merkle-runs")
    return dealt.join(runs, ["tree", "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``before`` and ``after``: the digests of the run's other nodes left and right of each node, one behind the other."""
    slot = F.col("place") % arity
    if arity == 2:
        others = nodes.select("tree", F.col("place").bitwiseXOR(F.lit(1)).alias("place"), F.col("digest").alias("_other"))
        found = nodes.join(others, ["tree", "place"], "left")
        other = F.coalesce("_other", F.lit(""))
        return found.withColumn("before", F.when(slot == 1, other).otherwise("")).withColumn("after", F.when(slot == 0, other).otherwise("")).drop("_other")
    found = nodes
    for offset in range(1, arity):
        seen_from = F.col("place") - slot + F.pmod(slot - offset, F.lit(arity))
        others = nodes.select("tree", seen_from.alias("place"), F.struct(slot.alias("slot"), "digest").alias(f"_other{offset}"))
        found = found.join(others, ["tree", "place"], "left")
    names = [f"_other{offset}" for offset in range(1, arity)]
    run = F.array_sort(F.array_compact(F.array(*names)))

    def side(kept) -> Column:
        return F.array_join(F.transform(F.filter(run, kept), lambda o: o["digest"]), "")

    found = found.withColumn("_slot", slot)
    return found.withColumn("before", side(lambda o: o["slot"] < F.col("_slot"))).withColumn("after", side(lambda o: o["slot"] > F.col("_slot"))).drop("_slot", *names)


def grow(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels from the leaves up, and the roots as (tree, height, digest).

    ``leaves`` has tree, place, size (the tree's number of leaves) and digest; other columns stay on the lowest level. A level
    holds the nodes of trees that have more than one node there.
    """
    size = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    roots = leaves.where("size = 1").select("tree", F.lit(0).alias("height"), "digest")
    levels, nodes = [], leaves.where("size > 1")
    while size > 1:
        level = materialize(with_siblings(nodes, arity), f"merkle-level{len(levels)}")
        levels.append(level)
        size = -(-size // arity)
        nodes = level.where(F.col("place") % arity == 0).select(
            "tree", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("size") / arity).alias("size"),
            digest(F.concat("digest", "after")).alias("digest"),
        )
        roots = roots.unionByName(nodes.where("size = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        nodes = nodes.where("size > 1")
    return levels, roots


def proofs(levels: list[DataFrame], tops: DataFrame, arity: int, columns: Sequence[str] = ()) -> DataFrame:
    """(tree, place, columns, steps, top columns) of every leaf; ``tops`` (tree, height, steps, …) has what each root hands down."""
    carried = [c for c in tops.columns if c not in ("tree", "height", "steps")]
    above = tops.where(F.col("height") == len(levels)).select("tree", F.lit(0).cast("bigint").alias("place"), "steps", *carried)
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number]
        own = F.array(F.struct("before", "after")).cast(f"array<{STEP}>")
        names = list(columns) if number == 0 else []
        below = level.withColumn("_parent", F.floor(F.col("place") / arity)).select(
            "tree", "place", "_parent", own.alias("_own"), *names
        ).join(above.withColumnRenamed("place", "_parent"), ["tree", "_parent"])
        below = below.select("tree", "place", *names, F.concat("_own", "steps").alias("steps"), *carried)
        if number:
            ended = tops.where(F.col("height") == number).select("tree", F.lit(0).cast("bigint").alias("place"), "steps", *carried)
            below = below.unionByName(ended)
            if number % LEVELS_AT_ONCE == 0:
                below = materialize(below, f"merkle-proofs{number}")
        above = below
    return above


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda have, s: digest(F.concat(s["before"], have, s["after"])))


def proof_digest(steps: Column) -> Column:
    """One digest for all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(
    docs: DataFrame, part: str = "lang", order: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    arity: int = 2, claims: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: part, order column, place, leaf, subroot, root, steps, claimed_leaf.

    A leaf is the SHA-256 of the columns, each as its length and value. Leaves of a part ascend by ``order`` (nulls first, equal
    ones by digest, so that repeated rows are interchangeable leaves of their own); the parts' roots, no part first and then by
    the bytes of their names, are the leaves of the upper tree. ``steps`` has the digests of the run's other nodes from the leaf
    to the root. ``claims`` names columns whose values somebody claims to be others: ``claimed_leaf`` is the leaf they give.
    A lone leaf is its part's root, a lone part's root is the root. Columns other than those named play no part, whatever
    their names; an empty table gives an empty manifest.
    """
    claims = claims or {}
    changed = F.lit(False)
    for name, value in claims.items():
        changed = changed | ~F.col(name).eqNullSafe(value)
    claimed = row_digest([claims.get(c, F.col(c)) for c in columns]) if claims else F.lit(None).cast("string")
    leaves = materialize(docs.select(
        part_name(F.col(part)).alias("tree"), F.col(part).alias("part"), F.col(order).alias("key"),
        row_digest([F.col(c) for c in columns]).alias("digest"), F.when(changed, claimed).alias("claimed"),
    ), "merkle-leaves")
    own = ["part", "key", "digest", "claimed"]
    leaves = numbered(leaves, ["key", "digest"])
    levels, roots = grow(leaves, arity)
    roots = materialize(roots, "merkle-roots")

    upper = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), ["name"])
    upper_levels, root = grow(upper, arity)
    start = root.select("tree", F.col("height"), F.array().cast(f"array<{STEP}>").alias("steps"), F.col("digest").alias("root"))
    names = ["name", "height", "digest"]
    if upper_levels:
        tops = proofs(upper_levels, start, arity, [*names])
    else:
        tops = upper.join(start.drop("height"), "tree")
    tops = materialize(tops.select(F.col("name").alias("tree"), "height", "steps", F.col("digest").alias("subroot"), "root"), "merkle-tops")

    out = leaves.where("size = 1").join(tops.drop("height"), "tree").select("place", *own, "steps", "subroot", "root")
    if levels:
        out = proofs(levels, tops, arity, own).select("place", *own, "steps", "subroot", "root").unionByName(out)
    return out.select(
        F.col("part").alias(part), F.col("key").alias(order), "place", F.col("digest").alias("leaf"), "subroot", "root", "steps",
        F.coalesce("claimed", "digest").alias("claimed_leaf"),
    )
