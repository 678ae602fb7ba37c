"""Workflow graphs: build, loops, path checks, similarity, task separation, merging, diagnosis.

A workflow is a set of edge rows (workflow_id, src, dst, first_seq, n). Graph steps are joins; steps that
depend on earlier results (reset points, greedy merging) are solved exactly in bounded pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import keys as key_models
from .joins import lookup
from .sequences import CHUNK_ROWS, chunk_of, dense_position, lowest_before, range_position, running_sum, windowed

# Similarity below which no known template is named, demands of its search before that, weights and bound of workflow
# similarity, predictions looked at for task separation, share of direct successors for linking.
SIMILAR_KEY = 0.3
DEMANDS = (0.8, 0.6, 0.45)
ROUNDING = 1e-9
NODE_WEIGHT = 0.4
EDGE_WEIGHT = 0.6
MERGE_SIMILARITY = 0.7
TASK_TOP = 5
LINK_SHARE = 0.9
NAME_LENGTH = 50
#: Groups that the graphs of one edge are dealt to when they are compared.
DEALT = 16
#: Edges up to which the loops of a graph are found in one row.
SMALL_GRAPH = 64
#: Graphs of the first round of merging.
FIRST_BLOCK = 64


# --- building -------------------------------------------------------------------------------------------

def with_previous_key(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``prev_key``, the template before each line of a stream."""
    return windowed(
        rows, ["stream_id"], "seq", {"prev_key": lambda spec: F.lag("log_key", 1).over(spec)}, back=1, chunk_rows=chunk_rows
    )


def transitions(parsed: DataFrame, group: str = "stream_id", position: str = "seq",
                chunk_rows: int = CHUNK_ROWS, previous_key: str | None = None) -> DataFrame:
    """Edges of each group's template sequence; a group of fewer than two templates has none.

    ``previous_key`` names a column that holds the template before each line already, so that the lines need no order.
    """
    if previous_key:
        steps = parsed.select(group, position, "log_key", F.col(previous_key).alias("src"))
    else:
        steps = windowed(
            parsed.select(group, position, "log_key"), [group], position,
            {"src": lambda spec: F.lag("log_key", 1).over(spec)}, back=1, chunk_rows=chunk_rows,
        )
    pairs = steps.filter(F.col("src").isNotNull())
    return (
        pairs.groupBy(F.col(group).alias("workflow_id"), "src", F.col("log_key").alias("dst"))
        .agg((F.min(position) - 1).alias("first_seq"), F.count(F.lit(1)).alias("n"))
    )


def node_table(edges: DataFrame) -> DataFrame:
    """Nodes per workflow with the position of their first appearance; the earliest one is the start."""
    ends = edges.select("workflow_id", F.col("src").alias("log_key"), F.col("first_seq").alias("at")).unionByName(
        edges.select("workflow_id", F.col("dst").alias("log_key"), (F.col("first_seq") + 1).alias("at"))
    )
    nodes = ends.groupBy("workflow_id", "log_key").agg(F.min("at").alias("first_at"))
    starts = nodes.groupBy("workflow_id").agg(F.min_by("log_key", "first_at").alias("_start"))
    return nodes.join(starts, "workflow_id").select(
        "workflow_id", "log_key", "first_at", (F.col("log_key") == F.col("_start")).alias("is_start")
    )


def loop_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves: those of strongly connected components with an edge inside.

    A graph of at most ``SMALL_GRAPH`` edges is one row and is solved where it lies. Only larger ones take the joins of ``_large_loops``;
    these are merge joins, as a table that is small when stored can be large when it is sent through the driver.
    """
    keys = ["workflow_id", "src", "dst"]
    edges = materialize(edges.select(*keys).dropna(subset=keys).distinct(), "loop-edges")
    large = edges.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL_GRAPH)
    large = materialize(large.select("workflow_id"), "large-graphs").hint("merge")

    def on_loops(src: pd.Series, dst: pd.Series) -> pd.Series:
        """The nodes of each graph that can reach themselves; what a node reaches are the bits of one number."""
        found = []
        for a, b in zip(src, dst):
            bit = {node: i for i, node in enumerate(dict.fromkeys([*a, *b]))}
            reach = [0] * len(bit)
            for x, y in zip(a, b):
                reach[bit[x]] |= 1 << bit[y]
            for via in range(len(reach)):
                reach = [r | reach[via] if r >> via & 1 else r for r in reach]
            found.append([node for node, i in bit.items() if reach[i] >> i & 1])
        return pd.Series(found, dtype=object)

    kind = edges.schema["src"].dataType.simpleString()
    edge = F.collect_list(F.struct("src", "dst")).alias("_e")
    graphs = edges.join(large, "workflow_id", "left_anti").groupBy("workflow_id").agg(edge)
    small = graphs.select("workflow_id", F.explode(F.pandas_udf(on_loops, f"array<{kind}>")("_e.src", "_e.dst")).alias("log_key"))
    if large.isEmpty():
        return small
    return small.unionByName(_large_loops(edges.join(large, "workflow_id", "left_semi")))


def _large_loops(edges: DataFrame) -> DataFrame:
    """``loop_nodes`` of graphs of any size, by joins.

    Nodes that no edge enters or none leaves lie on no loop; they are peeled off round by round. Of what is left, nodes
    with one edge in and one out are passed over: pointers along such chains double in every round, so a chain costs the
    logarithm of its length, and a chain that ends nowhere is a loop. The components of the remaining crossings are found by colours.
    """
    left = _peeled(materialize(edges, "loop-edges"))
    if left.isEmpty():
        return left.select("workflow_id", F.col("src").alias("log_key"))
    ends = left.groupBy("workflow_id", F.col("src").alias("log_key")).agg(F.count(F.lit(1)).alias("_out"), F.min("dst").alias("next"))
    starts = left.groupBy("workflow_id", F.col("dst").alias("log_key")).agg(F.count(F.lit(1)).alias("_in"), F.min("src").alias("before"))
    single = materialize(
        ends.join(starts.hint("merge"), ["workflow_id", "log_key"]).filter("_in = 1 AND _out = 1").select("workflow_id", "log_key", "next", "before"), "chains"
    )
    after = _chain_ends(single, "next")
    ahead = _chain_ends(single, "before")
    chains = materialize(
        after.join(ahead.hint("merge"), ["workflow_id", "log_key"]).select("workflow_id", "log_key", F.col("before").alias("src"), F.col("next").alias("dst")), "chain-ends"
    )
    closed = chains.filter(F.col("src").isNull() | F.col("dst").isNull()).select("workflow_id", "log_key")
    passed = single.select("workflow_id", "log_key")
    crossings = (
        left.join(passed.withColumnRenamed("log_key", "src").hint("merge"), ["workflow_id", "src"], "left_anti")
        .join(passed.withColumnRenamed("log_key", "dst").hint("merge"), ["workflow_id", "dst"], "left_anti").select("workflow_id", "src", "dst")
    )
    over = chains.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    short = materialize(crossings.unionByName(over.select("workflow_id", "src", "dst")).distinct(), "crossings")
    parts = materialize(strong_components(short), "components")
    source = parts.select("workflow_id", F.col("log_key").alias("src"), F.col("component").alias("_a"))
    target = parts.select("workflow_id", F.col("log_key").alias("dst"), F.col("component").alias("_b"))

    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(source.hint("merge"), ["workflow_id", "src"]).join(target.hint("merge"), ["workflow_id", "dst"]).filter(F.col("_a") == F.col("_b"))

    crossed = inside(short).select("workflow_id", F.explode(F.array("src", "dst")).alias("log_key"))
    return closed.unionByName(inside(over).select("workflow_id", "log_key")).unionByName(crossed).distinct()


def _peeled(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that no edge enters or none leaves, round by round."""
    size = edges.count()
    while size:
        entered = edges.select("workflow_id", F.col("dst").alias("src")).distinct()
        quitted = edges.select("workflow_id", F.col("src").alias("dst")).distinct()
        edges = materialize(
            edges.join(entered.hint("merge"), ["workflow_id", "src"], "left_semi").join(quitted.hint("merge"), ["workflow_id", "dst"], "left_semi")
            .select("workflow_id", "src", "dst"), "loop-edges",
        )
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _chain_ends(single: DataFrame, column: str) -> DataFrame:
    """For each node of a chain the first node beyond the chain in the direction of ``column``; null on a chain that closes itself."""
    jumps = single.select("workflow_id", "log_key", column)
    rounds = jumps.count().bit_length()
    for _ in range(rounds):
        ahead = jumps.select("workflow_id", F.col("log_key").alias(column), F.col(column).alias("_far"))
        further = materialize(jumps.join(ahead.hint("merge"), ["workflow_id", column], "left"), "jumps")
        jumps = further.select("workflow_id", "log_key", F.coalesce("_far", column).alias(column))
        if further.filter(F.col("_far").isNotNull()).isEmpty():
            break
    inner = single.select("workflow_id", F.col("log_key").alias(column), F.lit(True).alias("_inner"))
    return jumps.join(inner.hint("merge"), ["workflow_id", column], "left").select(
        "workflow_id", "log_key", F.when(F.col("_inner").isNull(), F.col(column)).alias(column)
    )


def strong_components(edges: DataFrame) -> DataFrame:
    """(workflow_id, log_key, component) of all nodes of ``edges``, by forward-backward colouring.

    The largest name that can reach a node is its colour. A node that has its own name as colour is in one component with the
    nodes of this colour that can reach it. Edges between colours, and nodes that are placed, are out for the next round.
    Rows are one per node and edge; no table of reachable pairs is made.
    """
    names = edges.select("workflow_id", F.explode(F.array("src", "dst")).alias("log_key")).distinct()
    edges = materialize(edges.select("workflow_id", "src", "dst").filter("src <> dst"), "scc-edges")
    placed = []
    while not edges.isEmpty():
        nodes = edges.select("workflow_id", F.explode(F.array("src", "dst")).alias("log_key")).distinct()
        colours = materialize(nodes.withColumn("colour", F.col("log_key")), "colours")
        while True:
            coming = edges.join(colours.withColumnRenamed("log_key", "src").hint("merge"), ["workflow_id", "src"]).groupBy(
                "workflow_id", F.col("dst").alias("log_key")).agg(F.max("colour").alias("_new"))
            step = materialize(
                colours.join(coming.hint("merge"), ["workflow_id", "log_key"], "left")
                .withColumn("_more", F.coalesce(F.col("_new") > F.col("colour"), F.lit(False)))
                .withColumn("colour", F.greatest("colour", "_new")).drop("_new"), "colours",
            )
            colours = step.drop("_more")
            if step.filter("_more").isEmpty():
                break
        tint = colours.withColumnRenamed("colour", "_c")
        same = materialize(
            edges.join(colours.withColumnRenamed("log_key", "src").hint("merge"), ["workflow_id", "src"])
            .join(tint.withColumnRenamed("log_key", "dst").hint("merge"), ["workflow_id", "dst"]).filter(F.col("colour") == F.col("_c"))
            .select("workflow_id", "src", "dst", "colour"), "same-colour",
        )
        found = materialize(colours.filter(F.col("log_key") == F.col("colour")), "members")
        fresh = found
        while not fresh.isEmpty():
            reached = same.join(fresh.select("workflow_id", F.col("log_key").alias("dst")).hint("merge"), ["workflow_id", "dst"], "left_semi").select(
                "workflow_id", F.col("src").alias("log_key"), "colour").distinct()
            fresh = materialize(reached.join(found.hint("merge"), ["workflow_id", "log_key"], "left_anti"), "members")
            found = found.unionByName(fresh)
        found = materialize(found, "component")
        placed.append(found.withColumnRenamed("colour", "component"))
        gone = found.select("workflow_id", "log_key")
        edges = materialize(
            same.join(gone.withColumnRenamed("log_key", "src").hint("merge"), ["workflow_id", "src"], "left_anti")
            .join(gone.withColumnRenamed("log_key", "dst").hint("merge"), ["workflow_id", "dst"], "left_anti").select("workflow_id", "src", "dst"), "scc-edges",
        )
    out = names.limit(0).withColumn("component", F.col("log_key"))
    for part in placed:
        out = out.unionByName(part)
    alone = names.join(out.select("workflow_id", "log_key").hint("merge"), ["workflow_id", "log_key"], "left_anti")
    return out.unionByName(alone.withColumn("component", F.col("log_key")))


def successors(edges: DataFrame, count: int = 3) -> DataFrame:
    """The first ``count`` successors of every node in order of appearance, names shortened."""
    ranked = edges.withColumn(
        "_r", F.row_number().over(Window.partitionBy("workflow_id", "src").orderBy("first_seq", "dst"))
    ).filter(F.col("_r") <= count)
    return ranked.groupBy("workflow_id", "src").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", F.substring("dst", 1, NAME_LENGTH).alias("key")))),
            lambda s: s["key"],
        ).alias("expected")
    )


# --- checking -------------------------------------------------------------------------------------------

def check_paths(parsed: DataFrame, edges: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The first problem of every sequence against the workflow named by ``workflow_id``.

    ``parsed`` holds workflow_id, stream_id, seq, log_key. Problems are an unknown template, or a step that
    is no edge and does not start from a loop node. The first template is checked only for being known.
    """
    nodes = materialize(node_table(edges).select("workflow_id", "log_key", F.lit(True).alias("known")), "nodes")
    steps = windowed(
        parsed.select("workflow_id", "stream_id", "seq", "log_key"), ["workflow_id", "stream_id"], "seq",
        {"src": lambda spec: F.lag("log_key", 1).over(spec)}, back=1, chunk_rows=chunk_rows,
    )
    valid = materialize(
        edges.select("workflow_id", "src", F.col("dst").alias("log_key"), F.lit(True).alias("edge")), "valid"
    )
    loops = loop_nodes(edges).select("workflow_id", F.col("log_key").alias("src"), F.lit(True).alias("loop"))
    checked = lookup(lookup(steps, nodes, ["workflow_id", "log_key"]), valid, ["workflow_id", "src", "log_key"])
    checked = lookup(checked, materialize(loops, "loops"), ["workflow_id", "src"])
    problem = F.when(F.col("known").isNull(), "unknown_key").when(
        F.col("src").isNotNull() & F.col("edge").isNull() & F.col("loop").isNull(), "invalid_transition"
    )
    first = (
        checked.withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .groupBy("workflow_id", "stream_id")
        .agg(F.min("seq").alias("position"), F.min_by(F.struct("problem", "src", "log_key"), "seq").alias("_p"))
        .select("workflow_id", "stream_id", "position", "_p.problem", "_p.src", "_p.log_key")
    )
    return first.join(successors(edges), ["workflow_id", "src"], "left")


def tokens(column: str) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != ""))


def _pruned_pairs(left: DataFrame, right: DataFrame, item: str, bound: float) -> DataFrame:
    """Candidate (left_id, right_id) pairs that can reach a Jaccard similarity of ``bound``.

    Both sides hold (id, items). Items are ordered by rarity; two sets of the required similarity share an
    item among the first ``size - ceil(bound * size) + 1`` of each, so frequent items are never joined on.
    """
    every = left.select(F.explode("items").alias(item)).unionAll(right.select(F.explode("items").alias(item)))
    frequency = every.groupBy(item).agg(F.count(F.lit(1)).alias("_freq"))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        rows = side.select("id", F.size("items").alias("size"), F.explode("items").alias(item)).join(frequency, item)
        rank = F.row_number().over(Window.partitionBy("id").orderBy("_freq", item))
        keep = F.col("size") - F.ceil(F.col("size") * F.lit(bound)) + 1
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= keep).select(
            item, F.col("id").alias(f"{name}_id"), F.col("size").alias(f"{name}_size")
        )

    shorter = F.least("left_size", "right_size")
    longer = F.greatest("left_size", "right_size")
    return (
        prefixes(left, "left")
        .join(prefixes(right, "right"), item)
        .filter(shorter >= longer * F.lit(bound))
        .select("left_id", "right_id")
        .distinct()
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def similar_keys(unknown: DataFrame, known: DataFrame, bound: float = SIMILAR_KEY) -> DataFrame:
    """For every unknown template the most similar known one by shared words, if similar enough.

    Both sides hold log_key. Ties go to the alphabetically first known template. The search first demands much, so that only the rarest
    words of a template are looked up. Whoever has found a template that similar is done, as nothing better is left; for the others the
    demand falls, yet never below the best found so far.
    """
    left = unknown.select(F.col("log_key").alias("id"), tokens("log_key").alias("items")).distinct()
    right = known.select(F.col("log_key").alias("id"), tokens("log_key").alias("items")).distinct()
    words = left.select(F.explode("items").alias("word")).unionAll(right.select(F.explode("items").alias("word")))
    frequency = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")), "word-counts")
    left, right = (materialize(_rarest_first(side, frequency), name) for side, name in ((left, "left"), (right, "right")))
    postings = right.withColumn("need", F.lit(bound)).select("*", F.posexplode("items").alias("rank", "word")).filter(_in_prefix("size", "rank", "need"))
    postings = materialize(postings.select("word", F.col("id").alias("similar_key"), F.col("size").alias("r_size"), F.col("rank").alias("r_rank")), "postings")
    settled, waiting = None, left.withColumn("best", F.lit(0.0))
    for demand in [d for d in DEMANDS if d > bound] + [bound]:
        asked = waiting.withColumn("need", F.greatest(F.lit(demand), "best")).drop("best")
        pairs = _prefix_pairs(asked, postings)
        scored = pairs.join(left.select("id", F.col("items").alias("_a")), "id").join(
            right.select(F.col("id").alias("similar_key"), F.col("items").alias("_b")), "similar_key"
        ).select("id", F.struct((-jaccard(F.col("_a"), F.col("_b"))).alias("s"), "similar_key").alias("_c"))
        best = scored.groupBy("id").agg(F.min("_c").alias("_c")).select("id", (-F.col("_c.s")).alias("best"), "_c.similar_key")
        best = materialize(best, "best-found")
        done = best.filter(F.col("best") >= demand)
        settled = done if settled is None else settled.unionByName(done)
        waiting = waiting.drop("best").join(best.drop("similar_key"), "id", "left").fillna(0.0, ["best"]).filter(F.col("best") < demand)
    return settled.select(F.col("id").alias("log_key"), "similar_key", F.col("best").alias("similarity"))


def _rarest_first(side: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, items, size): the words of every template that has any, rare ones first."""
    rows = side.select("id", F.explode("items").alias("word")).join(frequency, "word")
    sets = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "word"))).alias("_w"))
    return sets.select("id", F.col("_w.word").alias("items"), F.size("_w").alias("size"))


def _in_prefix(size: str, rank: str, need: str) -> Column:
    """Whether two sets of similarity ``need`` must share an item of this rank or an earlier one; ranks count from 0."""
    return F.col(rank) <= F.col(size) - F.ceil(F.col(size) * F.col(need) - ROUNDING)


def _prefix_pairs(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, similar_key) that may reach the similarity ``need`` of the asking row, by prefix, length and place of the shared word."""
    probe = asked.select("id", "size", "need", F.posexplode("items").alias("rank", "word")).filter(_in_prefix("size", "rank", "need"))
    need, size, r_size = F.col("need"), F.col("size"), F.col("r_size")
    # of the first word that both share no more than the words behind it can be common as well
    shared = F.least(size - F.col("rank"), r_size - F.col("r_rank"))
    return (
        probe.join(postings, "word")
        .filter(_in_prefix("r_size", "r_rank", "need"))
        .filter(F.least(size, r_size) >= F.greatest(size, r_size) * need - ROUNDING)
        .filter(shared >= F.ceil((size + r_size) * need / (need + 1) - ROUNDING))
        .select("id", "similar_key")
        .distinct()
    )


# --- similarity and merging -----------------------------------------------------------------------------

def graph_sets(edges: DataFrame) -> DataFrame:
    """Per distinct graph: node set, edge set and the smallest id of the workflows that have it.

    The sets of one graph are bounded by its distinct templates, not by its lines. Equal graphs are
    folded into one row, so that thousands of runs of the same task count once.
    """
    edge = F.struct("src", "dst")
    sets = edges.groupBy("workflow_id").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    return sets.groupBy("edges").agg(F.min("workflow_id").alias("id"), F.count(F.lit(1)).alias("copies")).select(
        "id", "copies", "edges",
        F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))).alias("nodes"),
    )


def numbered_sets(sets: DataFrame) -> DataFrame:
    """(id, edges, nodes, edge_bits, node_bits) of graphs: edges and nodes as ascending numbers, rare ones first, stored.

    Each of the 64 bits stands for the numbers of one remainder that are in the set.
    """
    edge = F.transform("edges", lambda e: F.struct(F.lit(True).alias("is_edge"), e["src"].alias("a"), e["dst"].alias("b")))
    node = F.transform("nodes", lambda n: F.struct(F.lit(False).alias("is_edge"), n.alias("a"), F.lit(None).cast("string").alias("b")))
    items = sets.select("id", F.explode(F.concat(edge, node)).alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    numbers = materialize(range_position(counts, ["freq", "item"], "number").select("item", "number"), "item-numbers")
    rows = lookup(items, numbers, ["item"], "inner").groupBy("id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("item.is_edge") == kind, F.col("number")))).alias(name)
        for name, kind in (("edges", True), ("nodes", False))
    ])
    bits = "aggregate({}, 0L, (found, n) -> found | shiftleft(1L, cast(pmod(n, 64) AS int)))"
    return materialize(rows.withColumns({"edge_bits": F.expr(bits.format("edges")), "node_bits": F.expr(bits.format("nodes"))}), "numbered")


def _near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id) of the graphs of two numbered tables whose weighted similarity may reach the threshold.

    The similarity is 0.4 times that of the nodes plus 0.6 times that of the edges, so a pair needs an edge similarity of at
    least (threshold - 0.4) / 0.6 and shares one of its rarest edges. Of what is joined on these only the pairs are kept whose
    bits leave enough in common: a bit that only one set has stands for an item that the other lacks. A few items may be in all
    graphs, so the left rows of one item are dealt to ``DEALT`` groups, each of which meets all its right rows.
    """
    least = (threshold - NODE_WEIGHT) / EDGE_WEIGHT
    size = F.size("edges")
    rarest = F.slice("edges", F.lit(1), (size - F.ceil(size * F.lit(least) - ROUNDING) + 1).cast("int"))
    shared = F.explode(rarest if least > 0 else F.col("nodes"))  # without a bound on edges a common node may be enough

    def probes(side: DataFrame, name: str) -> DataFrame:
        values = [F.col("id").alias(f"{name}_id")]
        for kind in ("edge", "node"):
            values += [F.size(f"{kind}s").alias(f"{name}_{kind}s"), F.col(f"{kind}_bits").alias(f"{name}_{kind}_bits")]
        return side.select(shared.alias("item"), *values)

    def similar_at_most(kind: str) -> Column:
        a, b = F.col(f"left_{kind}_bits"), F.col(f"right_{kind}_bits")
        a_size, b_size = F.col(f"left_{kind}s"), F.col(f"right_{kind}s")
        common = F.least(
            a_size - F.bit_count(a.bitwiseAND(F.bitwise_not(b))), b_size - F.bit_count(b.bitwiseAND(F.bitwise_not(a)))
        )
        return common / (a_size + b_size - common)

    dealt = probes(left, "left").withColumn("group", F.pmod(F.xxhash64("left_id"), F.lit(DEALT)).cast("int"))
    repeated = probes(right, "right").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    at_most = NODE_WEIGHT * similar_at_most("node") + EDGE_WEIGHT * similar_at_most("edge")
    met = dealt.join(repeated.hint("merge"), ["item", "group"]).filter(at_most >= threshold - ROUNDING)
    return met.select("left_id", "right_id").distinct()


def _alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of the graphs of two numbered tables whose weighted similarity reaches the threshold."""
    a = left.select(F.col("id").alias("left_id"), F.col("nodes").alias("_na"), F.col("edges").alias("_ea"))
    b = right.select(F.col("id").alias("right_id"), F.col("nodes").alias("_nb"), F.col("edges").alias("_eb"))
    similarity = NODE_WEIGHT * jaccard(F.col("_na"), F.col("_nb")) + EDGE_WEIGHT * jaccard(F.col("_ea"), F.col("_eb"))
    return (
        _near(left, right, threshold).join(a, "left_id").join(b, "right_id")
        .select("left_id", "right_id", similarity.alias("similarity"))
        .filter(F.col("similarity") >= threshold - 1e-12)
    )


def similar_workflows(sets: DataFrame, threshold: float = MERGE_SIMILARITY) -> DataFrame:
    """All pairs (a, b), a < b, of distinct graphs whose similarity reaches the threshold. Merging needs none of them stored."""
    return _similar_pairs(numbered_sets(sets), threshold)


def _similar_pairs(numbered: DataFrame, threshold: float) -> DataFrame:
    pairs = _alike(numbered, numbered, threshold).filter(F.col("left_id") < F.col("right_id"))
    return pairs.withColumnsRenamed({"left_id": "a", "right_id": "b"})


def leaders(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy leaders in id order: a graph joins the first leader it is similar to, else leads itself.

    Round by round, a graph without an undecided smaller neighbour becomes a leader, and the larger
    neighbours of leaders become members. Every round decides at least the smallest graph that is open, so the rounds end;
    pairs with a decided graph are dropped. The outcome is that of the sequential pass.
    """
    open_ids = materialize(ids.select("id"), "open")
    edges = materialize(pairs.select("a", "b"), "block-pairs")
    live, decided = edges, open_ids.limit(0)
    while not open_ids.isEmpty():
        fresh = materialize(open_ids.join(live.select(F.col("b").alias("id")), "id", "left_anti"), "leaders")
        taken = live.join(fresh.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        decided = decided.unionByName(fresh)
        open_ids = materialize(
            open_ids.join(fresh, "id", "left_anti").join(taken, "id", "left_anti"), "open"
        )
        live = materialize(
            live.join(open_ids.withColumnRenamed("id", "a"), "a", "left_semi")
            .join(open_ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "similar",
        )
    members = (
        edges.join(decided.withColumnRenamed("id", "a"), "a", "left_semi")
        .join(decided.withColumnRenamed("id", "b"), "b", "left_anti")
        .groupBy(F.col("b").alias("id"))
        .agg(F.min("a").alias("leader"))
    )
    return decided.select("id", F.col("id").alias("leader")).unionByName(members)


def greedy_leaders(sets: DataFrame, threshold: float = MERGE_SIMILARITY, first_block: int = FIRST_BLOCK) -> DataFrame:
    """(id, leader) of every graph by the sequential pass in id order, without a table of similar pairs.

    Each round takes the next graphs that no leader has claimed, finds the leaders among them, and lets all graphs behind them
    probe the edges of these new leaders only; what they claim is out. The block doubles while its graphs all lead, and starts
    small again where they don't. Its first graphs probe it beforehand: a block that they claim most of is cut to them, so the
    pairs inside a block stay few even where thousands of graphs in a row are alike. Stored rows grow as the graphs do.
    """
    waiting, decided, size = numbered_sets(sets), [], first_block

    def up_to(rows: DataFrame, count: int) -> DataFrame:
        last = rows.select("id").orderBy("id").limit(count).agg(F.max("id").alias("_last"))
        return rows.join(F.broadcast(last), F.col("id") <= F.col("_last")).drop("_last")

    def claimed_by(rows: DataFrame, lead: DataFrame) -> DataFrame:
        found = _alike(rows, lead, threshold).groupBy(F.col("left_id").alias("id")).agg(F.min("right_id").alias("leader"))
        return materialize(found, "claimed")

    while True:
        block = materialize(up_to(waiting, size), "block")
        taken = block.count()
        if not taken:
            break
        if taken > first_block:
            front = materialize(up_to(block, first_block), "block")
            alone = leaders(front, _similar_pairs(front, threshold)).filter("id = leader").select("id")
            rest = block.join(front.select("id"), "id", "left_anti")
            if 2 * claimed_by(rest, front.join(alone, "id", "left_semi")).count() > taken - first_block:
                block, taken = front, first_block
        inside = materialize(leaders(block, _similar_pairs(block, threshold)), "block-leaders")
        lead = materialize(block.join(inside.filter("id = leader").select("id"), "id", "left_semi"), "new-leaders")
        behind = waiting.join(block.select("id"), "id", "left_anti")
        claimed = claimed_by(behind, lead)
        decided += [inside, claimed]
        waiting = materialize(behind.join(claimed.select("id"), "id", "left_anti"), "open-graphs")
        size = 2 * size if lead.count() == taken else first_block
    out = sets.select("id", F.col("id").alias("leader")).limit(0)
    for part in decided:
        out = out.unionByName(part)
    return out


def merge_workflows(edges: DataFrame, threshold: float = MERGE_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Merge similar workflows: (merged edges, workflow_id -> merged_id).

    Workflows without edges stay out, as they are similar to none. A merged workflow has the distinct
    edges of its members and the id of its leader.
    """
    sets = materialize(graph_sets(edges), "graphs")
    lead = materialize(greedy_leaders(sets, threshold), "lead")
    edge = F.struct("src", "dst")
    shapes = edges.groupBy("workflow_id").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    mapping = (
        shapes.join(sets.select("edges", "id"), "edges")
        .join(lead, "id")
        .select("workflow_id", F.col("leader").alias("merged_id"))
    )
    mapping = materialize(mapping, "mapping")
    merged = (
        edges.join(mapping, "workflow_id")
        .groupBy(F.col("merged_id").alias("workflow_id"), "src", "dst")
        .agg(F.min(F.struct("workflow_id", "first_seq")).alias("_f"), F.sum("n").alias("n"))
        .select("workflow_id", "src", "dst", F.col("_f.first_seq").alias("first_seq"), "n")
    )
    return merged, mapping


# --- task separation ------------------------------------------------------------------------------------

def divergences(parsed: DataFrame, model: key_models.KeyModel, top: int = TASK_TOP,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``diverges``: neither this template nor the next one is predicted from the full history."""
    window = model.window
    coded = key_models.encode(parsed.select("stream_id", "seq", "log_key"), model.vocab)
    rows = windowed(
        coded, ["stream_id"], "seq",
        {"_hist": key_models.previous("key_id", window), "_next": lambda spec: F.lead("key_id", 1).over(spec)},
        back=window, ahead=1, chunk_rows=chunk_rows,
    ).withColumn("hist", F.when(F.col("seq") > window, F.col("_hist")))
    full = rows.select("hist").filter(F.col("hist").isNotNull()).distinct()
    answers = key_models.predict(model, full).select("hist", F.slice("ids", 1, top).alias("_top"))
    # Rows without a full history look up an empty one, which no answer has.
    keyed = rows.withColumn("hist", F.coalesce("hist", F.array().cast("array<bigint>")))
    joined = lookup(keyed, materialize(answers, "task-answers"), ["hist"])
    diverges = (
        F.col("_top").isNotNull() & F.col("_next").isNotNull()
        & ~F.array_contains("_top", F.col("key_id")) & ~F.array_contains("_top", F.col("_next"))
    )
    return joined.select("stream_id", "seq", "log_key", F.coalesce(diverges, F.lit(False)).alias("diverges"))


def tasks_without_reset(flagged: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Task number as the running count of divergences: every divergence starts a task."""
    return running_sum(flagged, ["stream_id"], "seq", F.col("diverges").cast("bigint"), "task_id", chunk_rows)


def tasks_by_model(flagged: DataFrame, window: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Task number where a divergence also resets the history.

    After a start at position p, the history is full again at p + window, so the next start is the first
    divergence from there on. A chunk of lines only needs to know how many of its first rows are still
    blocked. For each of these few cases it says where it ends; chaining the answers of the chunks, one
    small row each, gives every chunk its case, and the starts follow chunk by chunk. Each step passes over sorted
    rows, as most streams are far too short to be a group of their own in Python.
    """
    flagged = flagged.withColumn("_chunk", chunk_of(F.col("seq"), chunk_rows))
    marks = flagged.filter(F.col("diverges") & F.col("stream_id").isNotNull()).select("stream_id", "_chunk", "seq")
    marks = materialize(marks, "divergences")
    kind = flagged.schema["stream_id"].dataType.simpleString()
    keys = ["stream_id", "_chunk"]

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ends = None, []
        for pdf in batches:
            done = []
            for sid, chunk, p in zip(pdf["stream_id"], pdf["_chunk"], pdf["seq"]):
                if (sid, chunk) != group:
                    if group:
                        done.append((*group, ends))
                    group, ends = (sid, chunk), [chunk * chunk_rows + 1 + blocked for blocked in range(window)]
                ends = [p + window if p >= free_from else free_from for free_from in ends]
            yield pd.DataFrame(done, columns=[*keys, "ends"])
        if group:
            yield pd.DataFrame([(*group, ends)], columns=[*keys, "ends"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, free_from = None, 1
        for pdf in batches:
            out = []
            for sid, chunk, ends in zip(pdf["stream_id"], pdf["_chunk"], pdf["ends"]):
                if sid != stream:
                    stream, free_from = sid, 1
                out.append(free_from)
                blocked = max(0, free_from - (chunk * chunk_rows + 1))
                free_from = int(ends[blocked]) if blocked < window else free_from
            yield pdf[keys].assign(free_from=out)

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free_from = None, 1
        for pdf in batches:
            found = []
            for sid, chunk, p, entry in zip(pdf["stream_id"], pdf["_chunk"], pdf["seq"], pdf["free_from"]):
                if (sid, chunk) != group:
                    group, free_from = (sid, chunk), entry
                if p >= free_from:
                    found.append((sid, p))
                    free_from = p + window
            yield pd.DataFrame(found, columns=["stream_id", "seq"])

    def sorted_by(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*dict.fromkeys([*group, order]))

    summary = sorted_by(marks, keys, "seq").mapInPandas(cases, f"stream_id {kind}, _chunk bigint, ends array<bigint>")
    entries = sorted_by(summary, ["stream_id"], "_chunk").mapInPandas(chain, f"stream_id {kind}, _chunk bigint, free_from bigint")
    entered = marks.join(materialize(entries, "task-entries"), keys)
    begun = sorted_by(entered, keys, "seq").mapInPandas(starts, f"stream_id {kind}, seq bigint").withColumn("_start", F.lit(1))
    begun = materialize(begun, "task-starts")
    rows = flagged.drop("_chunk").join(begun, ["stream_id", "seq"], "left")
    return running_sum(
        rows, ["stream_id"], "seq", F.coalesce(F.col("_start"), F.lit(0)).cast("bigint"), "task_id", chunk_rows
    ).drop("_start")


def cooccurrence(parsed: DataFrame, distance: int = 1, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Share of b within ``distance`` steps after a: pairs / (distance * count of a)."""
    rows = windowed(
        parsed.select("stream_id", "seq", "log_key"), ["stream_id"], "seq",
        {"_after": lambda spec: F.array_compact(F.array(*[F.lead("log_key", i).over(spec) for i in range(1, distance + 1)]))},
        ahead=distance, chunk_rows=chunk_rows,
    )
    pairs = rows.select(F.col("log_key").alias("a"), F.explode("_after").alias("b")).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = parsed.groupBy(F.col("log_key").alias("a")).agg(F.count(F.lit(1)).alias("n_a"))
    return pairs.join(totals, "a").select("a", "b", "n", "n_a", (F.col("n") / (F.col("n_a") * distance)).alias("p"))


def task_links(parsed: DataFrame, share: float = LINK_SHARE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per stream and template a the one template that follows it in more than ``share`` of all cases."""
    pairs = windowed(
        parsed.select("stream_id", "seq", "log_key"), ["stream_id"], "seq",
        {"b": lambda spec: F.lead("log_key", 1).over(spec)}, ahead=1, chunk_rows=chunk_rows,
    )
    follows = pairs.groupBy("stream_id", F.col("log_key").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    totals = parsed.groupBy("stream_id", F.col("log_key").alias("a")).agg(F.count(F.lit(1)).alias("n_a"))
    return (
        follows.filter(F.col("b").isNotNull())
        .join(totals, ["stream_id", "a"])
        .filter(F.col("n") / F.col("n_a") > share)
        .select("stream_id", "a", "b")
    )


def tasks_by_cooccurrence(
    parsed: DataFrame, share: float = LINK_SHARE, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Task of every line, named by the line number of the task's first line.

    A line joins the oldest task that waits for its template, and lets this task wait for the template's
    link. How many tasks wait for a template follows from running sums alone. Tasks that wait for a template which only
    first templates lead to begin to wait in the order of their age, so the n-th waiting line and the n-th served line
    belong together. Templates further along are served by age, in one ordered pass for each group of linked templates of a stream
    (queues of different groups never meet) that holds no more than the waiting tasks.
    """
    rows = parsed.select("stream_id", "seq", "log_key")
    links = materialize(task_links(rows, share, chunk_rows), "links")
    led_to = links.select("stream_id", F.col("b").alias("a")).distinct()
    hard = materialize(
        links.join(led_to, ["stream_id", "a"], "left_semi").select("stream_id", F.col("b").alias("log_key")).distinct(), "hard-keys"
    )

    # Simple targets: served or not by the number of waiting tasks.
    simple = links.join(hard.withColumnRenamed("log_key", "b"), ["stream_id", "b"], "left_anti")
    roles = materialize(
        simple.select("stream_id", F.col("a").alias("log_key"), F.col("b").alias("target"), F.lit(1).alias("step"))
        .unionByName(simple.select("stream_id", F.col("b").alias("log_key"), F.col("b").alias("target"), F.lit(-1).alias("step")).distinct())
        .groupBy("stream_id", "log_key").agg(F.collect_list(F.struct("target", "step")).alias("roles")), "roles",
    )
    steps = lookup(rows, roles, ["stream_id", "log_key"], "inner").select("stream_id", "seq", F.inline("roles"))
    group = ["stream_id", "target"]
    placed = dense_position(steps, group, ["seq"], chunk_of(F.col("seq"), chunk_rows), "_pos")
    placed = materialize(
        running_sum(placed, group, "_pos", F.col("step").cast("bigint"), "_sum", chunk_rows), "waiting"
    )
    lowest = lowest_before(placed, group, "_pos", "_sum", "_lowest", chunk_rows)
    is_served = (F.col("step") < 0) & (F.col("_sum") >= F.least(F.coalesce("_lowest", F.lit(0)), F.lit(0)))

    def ranked(part: DataFrame, name: str) -> DataFrame:
        return dense_position(
            part.select("stream_id", "target", "seq"), group, ["seq"], chunk_of(F.col("seq"), chunk_rows), "_rank"
        ).withColumnRenamed("seq", name)

    pairs = ranked(lowest.filter(is_served), "seq").join(
        ranked(placed.filter("step > 0"), "parent"), ["stream_id", "target", "_rank"]
    )
    roots = _follow(materialize(pairs.select("stream_id", "seq", "parent"), "parents"))
    named = rows.join(roots, ["stream_id", "seq"], "left").withColumn("task_id", F.coalesce("parent", "seq")).drop("parent")
    if hard.isEmpty():
        return named
    return _served_by_age(materialize(named, "simple-tasks"), links, hard)


def _follow(parents: DataFrame) -> DataFrame:
    """Replace the parent of every line by its first ancestor; the distance doubles in every round."""
    while True:
        upper = parents.select("stream_id", F.col("seq").alias("parent"), F.col("parent").alias("_above"))
        further = materialize(parents.join(upper, ["stream_id", "parent"], "left"), "ancestors")
        parents = further.select("stream_id", "seq", F.coalesce("_above", "parent").alias("parent"))
        if further.filter(F.col("_above").isNotNull()).isEmpty():
            break
    return parents


def _linked_groups(links: DataFrame) -> DataFrame:
    """(stream_id, log_key, linked) of all templates of ``links``; linked ones share their smallest name.

    A round hands the smallest name seen on by one link and along the name itself, so a chain takes few rounds.
    """
    both = materialize(
        links.select("stream_id", "a", "b").unionByName(links.select("stream_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "link-sides"
    )
    names = materialize(both.select("stream_id", F.col("a").alias("log_key"), F.col("a").alias("linked")).distinct(), "linked")
    while True:
        near = both.join(names.select("stream_id", F.col("log_key").alias("b"), "linked"), ["stream_id", "b"]).select("stream_id", F.col("a").alias("log_key"), "linked")
        far = names.select("stream_id", "log_key", F.col("linked").alias("_of")).join(
            names.select("stream_id", F.col("log_key").alias("_of"), "linked"), ["stream_id", "_of"]).select("stream_id", "log_key", "linked")
        least = near.unionByName(far).groupBy("stream_id", "log_key").agg(F.min("linked").alias("_new"))
        step = materialize(
            names.join(least, ["stream_id", "log_key"]).select(
                "stream_id", "log_key", F.least("linked", "_new").alias("linked"), (F.col("_new") < F.col("linked")).alias("_less")), "linked",
        )
        names = step.drop("_less")
        if step.filter("_less").isEmpty():
            return names


def _served_by_age(named: DataFrame, links: DataFrame, hard: DataFrame) -> DataFrame:
    """Serve the hard templates in line order, the oldest waiting task first."""
    kind = named.schema["stream_id"].dataType.simpleString()
    waits = materialize(links.join(hard.withColumnRenamed("log_key", "b"), ["stream_id", "b"], "left_semi").select("stream_id", "a", "b"), "hard-links")
    marks = (
        _linked_groups(waits).join(waits.select("stream_id", F.col("a").alias("log_key"), F.col("b").alias("next")), ["stream_id", "log_key"], "left")
        .join(hard.withColumn("is_hard", F.lit(True)), ["stream_id", "log_key"], "left")
    )
    involved = lookup(named, materialize(marks, "hard-marks"), ["stream_id", "log_key"], "inner")

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, waiting = None, {}
        for pdf in batches:
            tasks = []
            for sid, linked, key, nxt, is_hard, task in zip(
                pdf["stream_id"], pdf["linked"], pdf["log_key"], pdf["next"], pdf["is_hard"], pdf["task_id"]
            ):
                if (sid, linked) != group:
                    group, waiting = (sid, linked), {}
                if is_hard is True or is_hard == 1:
                    queue = waiting.get(key)
                    if queue:
                        task = heapq.heappop(queue)
                if nxt is not None and nxt == nxt:
                    heapq.heappush(waiting.setdefault(nxt, []), int(task))
                tasks.append(int(task))
            yield pd.DataFrame({"stream_id": pdf["stream_id"], "seq": pdf["seq"], "_task": tasks})

    served = (
        involved.repartition("stream_id", "linked").sortWithinPartitions("stream_id", "linked", "seq")
        .mapInPandas(serve, f"stream_id {kind}, seq bigint, _task bigint")
    )
    return (
        named.join(served, ["stream_id", "seq"], "left")
        .withColumn("task_id", F.coalesce("_task", "task_id")).drop("_task")
    )


def task_workflows(tasks: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges of every task as a workflow of its own; the id is the pair (stream_id, task_id)."""
    rows = windowed(
        tasks.select("stream_id", "seq", "task_id", "log_key"), ["stream_id"], "seq",
        {"_t": lambda spec: F.lag("task_id", 1).over(spec), "src": lambda spec: F.lag("log_key", 1).over(spec)},
        back=1, chunk_rows=chunk_rows,
    ).filter(F.col("_t") == F.col("task_id"))
    return rows.groupBy(
        F.struct("stream_id", "task_id").alias("workflow_id"), "src", F.col("log_key").alias("dst")
    ).agg((F.min("seq") - 1).alias("first_seq"), F.count(F.lit(1)).alias("n"))


def build_workflows(
    parsed: DataFrame, separate: Callable[[DataFrame], DataFrame], threshold: float = MERGE_SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """Separate lines into tasks, build the workflow of each task and merge similar ones.

    ``separate`` adds task_id to lines (stream_id, seq, log_key): ``tasks_by_model``, ``tasks_without_reset`` or
    ``tasks_by_cooccurrence``. Returns the merged edges and one row per task (workflow_id, merged_id, lines). A task of one line has no edge; it stays
    as a workflow of its own, similar to none.
    """
    tasks = materialize(separate(parsed).select("stream_id", "seq", "task_id", "log_key"), "tasks")
    name = F.concat_ws(":", F.col("stream_id").cast("string"), F.lpad(F.col("task_id").cast("string"), 9, "0"))
    inside = task_workflows(tasks).withColumns({"stream_id": F.col("workflow_id.stream_id"), "task_id": F.col("workflow_id.task_id")})
    edges = materialize(inside.withColumn("workflow_id", name).drop("stream_id", "task_id"), "task-edges")
    merged, mapping = merge_workflows(edges, threshold)
    sizes = tasks.groupBy(name.alias("workflow_id")).agg(F.count(F.lit(1)).alias("lines"))
    workflows = lookup(sizes, mapping, ["workflow_id"]).withColumn("merged_id", F.coalesce("merged_id", "workflow_id"))
    return merged, workflows.select("workflow_id", "merged_id", "lines")


# --- diagnosis ------------------------------------------------------------------------------------------

def diagnose(anomalies: DataFrame, edges: DataFrame) -> DataFrame:
    """Explain anomalies by workflows: (stream_id, seq, workflow_id, problem, diagnosis).

    ``anomalies`` holds stream_id, seq, log_key and prev_key. The workflow is the first one that knows the
    template, else the first one. The text names the problem, the steps expected there and the workflow.

    Both tables should be stored, as they are read more than once. At most one workflow per distinct template and the first
    one explain anything, so sizes, loops and successors are made of these.
    """
    nodes = materialize(node_table(edges), "nodes")
    home = materialize(nodes.groupBy("log_key").agg(F.min("workflow_id").alias("home")), "home")
    first = materialize(nodes.agg(F.min("workflow_id").alias("first_id")), "first")
    used = materialize(home.select(F.col("home").alias("workflow_id")).unionByName(first.withColumnRenamed("first_id", "workflow_id")).distinct(), "used")
    edges = materialize(lookup(edges, used, ["workflow_id"], "left_semi"), "edges-used")
    sizes = lookup(nodes, used, ["workflow_id"], "left_semi").groupBy("workflow_id").agg(F.count(F.lit(1)).alias("steps"), F.max(
        F.when(F.col("is_start"), F.col("log_key"))).alias("start"))
    sizes = materialize(sizes, "sizes")
    placed = (
        lookup(anomalies.select("stream_id", "seq", "log_key", "prev_key"), home, ["log_key"])
        .join(F.broadcast(first))
        .withColumn("workflow_id", F.coalesce("home", "first_id"))
    )
    templates = materialize(anomalies.select("log_key").distinct(), "anomaly-templates")
    unknown = lookup(templates, home.filter(F.col("home").isNotNull()), ["log_key"], "left_anti")
    in_first = nodes.join(F.broadcast(first), F.col("workflow_id") == F.col("first_id")).select("log_key")
    similar = materialize(similar_keys(unknown, in_first), "similar-keys").select("log_key", "similar_key")
    valid = edges.select("workflow_id", F.col("src").alias("prev_key"), F.col("dst").alias("log_key"), F.lit(True).alias("edge"))
    loops = materialize(
        loop_nodes(edges).select("workflow_id", F.col("log_key").alias("prev_key"), F.lit(True).alias("loop")), "loops")
    nexts = materialize(successors(edges), "successors")

    def expected_from(rows: DataFrame, column: str, out: str) -> DataFrame:
        return lookup(rows, nexts.select("workflow_id", F.col("src").alias(column), F.col("expected").alias(out)),
                      ["workflow_id", column])

    rows = lookup(placed, sizes, ["workflow_id"])
    rows = lookup(lookup(rows, valid, ["workflow_id", "prev_key", "log_key"]), loops, ["workflow_id", "prev_key"])
    rows = lookup(rows, similar, ["log_key"])
    for column in ("prev_key", "log_key", "start"):
        rows = expected_from(rows, column, f"_after_{column}")
    problem = F.when(F.col("home").isNull(), "unknown_key").when(
        F.col("prev_key").isNotNull() & F.col("edge").isNull() & F.col("loop").isNull(), "invalid_transition"
    )
    short = F.substring("log_key", 1, NAME_LENGTH)
    error = F.when(
        F.col("home").isNull() & F.col("similar_key").isNotNull(),
        F.concat(F.lit("unknown template: "), short, F.lit(", most similar: "), F.substring("similar_key", 1, NAME_LENGTH)),
    ).when(F.col("home").isNull(), F.concat(F.lit("unknown template: "), short)).when(
        problem.isNotNull(),
        F.concat(F.lit("invalid step: "), F.substring("prev_key", 1, NAME_LENGTH), F.lit(" -> "), short),
    )
    expected = F.when(problem.isNull(), F.col("_after_log_key")).otherwise(
        F.coalesce("_after_prev_key", "_after_start")
    )
    return rows.select(
        "stream_id", "seq", "workflow_id", problem.alias("problem"),
        F.concat_ws(
            " | ", error,
            F.when(F.size(expected) > 0, F.concat(F.lit("expected next: "), F.concat_ws(", ", expected))),
            F.concat(F.lit("workflow with "), F.col("steps").cast("string"), F.lit(" steps")),
        ).alias("diagnosis"),
    )
