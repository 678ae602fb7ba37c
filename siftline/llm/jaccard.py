"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets form a class, and only one document per class goes on. Document frequencies come from
sketches that chunks of documents make and blocks of the fingerprint space add up; they order every set rare-first. Two sets
that reach the threshold share a shingle within their prefixes, so only prefix shingles that some other set has too are kept
and joined. Every candidate pair is verified once, on whole sets.

A shingle that many classes share doesn't emit all their pairs: each round links the members to one leader per shingle, and
members that are in one component by then need no further check. Once few pairs of different components are left, or a round
no longer halves them, all of them are checked, so no link between components is lost.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import materialize

from .exchange import MESSAGE, OWN, answers, by_block, chunk_count, chunk_of, cut_by_block, messages, text_size
from .graph import components
from .words import ODD, U64, mix, pack, pack_sorted, pieces, text_bytes, unpack, unpack_sorted, window_starts, window_values, word_values

CHUNK_BYTES = 4 << 20
BLOCK_BITS = 23
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
PAIR_BATCH = "8m"  # of pairs with both their sets, on their way to a Python worker


def shingle_sets(texts: pa.Array, words: int):
    """The distinct shingles of every document, ascending, one array per document."""
    for piece in pieces(texts):
        values = word_values(piece, 3, lower=True)
        starts = window_starts(piece, words)
        grams = window_values(values, words)[starts]
        counts = piece.counts()
        edges = np.concatenate([[0], np.cumsum(np.maximum(counts - words + 1, 0))])
        whole = counts.astype(U64)
        odd = U64(ODD)
        for i in range(words - 1):
            has = np.flatnonzero((counts > i) & (counts < words))
            whole[has] = mix(whole[has] * odd + values[piece.doc_word[has] + i])
        for i in range(piece.docs):
            if counts[i] >= words:
                yield np.unique(grams[edges[i] : edges[i + 1]])
            else:
                yield whole[i : i + min(1, counts[i])]


def class_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    with np.errstate(over="ignore"):
        return np.array([mix(grams ^ U64(17)).sum(), mix(grams ^ U64(len(grams) + 71)).sum()], U64).tobytes()


def set_sizes(docs: DataFrame, words: int, chunks: int) -> DataFrame:
    """(id, digest, chunk, n, cls) per document."""

    def sizes(batches):
        for batch in batches:
            n, keys = [], []
            for grams in shingle_sets(batch["text"], words):
                n.append(len(grams))
                keys.append(class_key(grams))
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"], "digest": batch["digest"], "chunk": batch["chunk"], "n": pa.array(n, pa.int64()), "cls": pa.array(keys, pa.binary()),
            })

    return docs.mapInArrow(sizes, "id bigint, digest binary, chunk bigint, n bigint, cls binary")


def home_sets(table: pa.Table, homes: set[bytes], words: int):
    """One (class, shingles) per class that lives in this chunk."""
    left = set(homes)
    for grams in shingle_sets(table["text"], words):
        if len(grams) and (key := class_key(grams)) in left:
            left.discard(key)
            yield key, grams


def merge_frequencies(payloads: list[bytes]) -> list[bytes]:
    """How many sets hold each counter of a message, on a logarithmic scale; 0 means one."""
    counts = np.zeros(1 << BLOCK_BITS, np.int64)
    asked = []
    for payload in payloads:
        size = int.from_bytes(payload[:8], "little")
        at = unpack_sorted(payload[8 : 8 + size]).astype(np.int64)
        counts[at] += unpack(payload[8 + size :]).astype(np.int64)
        asked.append(at)
    return [pack(np.minimum(255, 6 * np.log2(counts[at])).astype(U64)) for at in asked]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def candidates(docs: DataFrame, classes: DataFrame, words: int, percent: int, size: int, chunks: int) -> DataFrame:
    """(cls, n, skip, prefix, tokens) of every class that shares a prefix shingle with another one.

    ``tokens`` holds the whole set rare-first: each number is the frequency's level and 56 bits of the shingle. ``prefix``
    are the shared shingles of the prefix, which begin at position ``skip``.
    """
    bits = min(56, max(BLOCK_BITS, math.ceil(math.log2(max(1, size / 6) * 16))))
    shift = U64(64 - bits)

    def counters(sets):
        return np.unique(np.concatenate([g for _, g in sets]) >> shift, return_counts=True) if sets else (np.zeros(0, U64),) * 2

    def ask(key, table, homes):
        chunk = key[0].as_py()
        sets = list(home_sets(table, set(homes["cls"].to_pylist()), words))
        distinct, n = counters(sets)
        out = [(chunk, OWN, b"".join(k for k, _ in sets))]
        for block, a, b in cut_by_block(distinct, distinct >> U64(BLOCK_BITS)):
            at = pack_sorted(distinct[a:b] & U64((1 << BLOCK_BITS) - 1))
            out.append((chunk, block, len(at).to_bytes(8, "little") + at + pack(n[a:b])))
        return messages(out)

    def order(key, table, got):
        got = by_block(got)
        own = got.get(OWN, b"")
        sets = list(home_sets(table, {own[i : i + 16] for i in range(0, len(own), 16)}, words))
        distinct, _ = counters(sets)
        level = np.zeros(len(distinct), U64)
        for block, a, b in cut_by_block(distinct, distinct >> U64(BLOCK_BITS)):
            level[a:b] = unpack(got[block])
        out = {"cls": [], "n": [], "skip": [], "prefix": [], "tokens": []}
        for k, grams in sets:
            tokens = np.sort((level[np.searchsorted(distinct, grams >> shift)] << U64(56)) | (grams >> U64(8)))
            skip, end = int(np.searchsorted(tokens, U64(1 << 56))), prefix_length(len(tokens), percent)
            if skip < end:
                out["cls"].append(k)
                out["n"].append(len(tokens))
                out["skip"].append(skip)
                out["prefix"].append(tokens[skip:end].view(np.int64))
                out["tokens"].append(tokens.tobytes())
        kinds = {"cls": pa.binary(), "n": pa.int64(), "skip": pa.int64(), "prefix": pa.list_(pa.int64()), "tokens": pa.binary()}
        return pa.table({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    homes = classes.select(F.col("home").alias("chunk"), "cls")
    asks = docs.groupBy("chunk").cogroup(homes.groupBy("chunk")).applyInArrow(ask, MESSAGE)
    counted = answers(asks, merge_frequencies)
    return docs.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        order, "cls binary, n bigint, skip bigint, prefix array<bigint>, tokens binary"
    )


def may_link(percent: int):
    """Length and positional filter of a pair (n, pos) and (n2, pos2) with a common shingle at these positions.

    The first shingle that two sets have in common has nothing common before it, so both need enough shingles from there on. A
    pair that links passes at that shingle; at later ones it needn't.
    """
    n, m = F.col("n"), F.col("n2")
    long_enough = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = F.least(n - F.col("pos"), m - F.col("pos2"))
    return long_enough & (most * (100 + percent) >= (n + m) * percent)


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """The suffix filter: no more than this many equal numbers in two ascending arrays, by halving them at a number."""
    if not depth or not len(a) or not len(b):
        return min(len(a), len(b))
    half = len(a) // 2
    at = int(np.searchsorted(b, a[half]))
    return overlap_bound(a[:half], b[:at], depth - 1) + overlap_bound(a[half:], b[at:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = (len(a) + len(b)) * percent
    if overlap_bound(a, b, 2) * (100 + percent) < need:
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) * (100 + percent) >= need


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def check(batches):
        for batch in batches:
            (left, i), (right, j) = text_bytes(batch["t"]), text_bytes(batch["t2"])
            keep = [
                linked(left[i[k] : i[k + 1]].view(U64), right[j[k] : j[k + 1]].view(U64), percent) for k in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tokens = sets.select("cls", "tokens")
    both = pairs.join(tokens.toDF("a", "t"), "a").join(tokens.toDF("b", "t2"), "b")
    return both.mapInArrow(check, "a binary, b binary")


def link_components(sets: DataFrame, percent: int, exhaustive_at: float) -> DataFrame:
    """(cls, component) of the classes with a link, in rounds as the module's text says."""
    members = sets.select("cls", "n", "skip", F.posexplode("prefix").alias("i", "token")).select(
        "token", "cls", "n", (F.col("skip") + F.col("i")).alias("pos"), (F.col("skip") / F.col("n")).alias("own"), F.col("cls").alias("component")
    )
    links, checked, found, before = None, None, None, math.inf
    while True:
        members, left = several_components(members)
        if not left["members"]:
            break
        last = found is not None and (left["pairs"] <= exhaustive_at * left["members"] or left["pairs"] > before / 2)
        before = left["pairs"]
        pairs = all_pairs(members, percent) if last else leader_pairs(members, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        with batches_of(sets.sparkSession, PAIR_BATCH):
            fresh = materialize(verify(pairs, sets, percent), "links")
        links = fresh if links is None else links.union(fresh)
        checked = pairs if checked is None else checked.union(pairs)
        found = components(links)
        if last:
            break
        found = materialize(found, "components")
        members = members.drop("component").join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").select(
            "token", "cls", "n", "pos", "own", F.coalesce("component", "cls").alias("component")
        )
    return found.select(F.col("node").alias("cls"), "component") if found is not None else sets.select("cls", F.col("cls").alias("component")).limit(0)


def several_components(members: DataFrame):
    """The members of shingles that more than one component holds, and how many there are and how many pairs they make."""
    sizes = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.count(F.lit(1)).alias("components"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")
    ).where("components > 1")
    sizes = materialize(sizes, "open-tokens")
    left = sizes.agg(F.sum("s").alias("members"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
    return materialize(members.join(sizes.select("token"), "token", "left_semi"), "members"), left


@contextmanager
def batches_of(spark: SparkSession, size: str):
    """Hand Python workers batches of at most this size, for jobs that run inside."""
    kept = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, kept)


def as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def leader_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member with its shingle's leader, where their components differ.

    The leader is the member with the smallest share of shingles of its own: the nearest to what all have in common.
    """
    leads = members.groupBy("token").agg(F.min(F.struct("own", "n", "cls", "pos", "component")).alias("lead")).select(
        "token", *[F.col("lead")[c].alias(f"{c}2") for c in ("cls", "n", "pos", "component")]
    )
    return as_pairs(members.join(leads, "token").where((F.col("component") != F.col("component2")) & may_link(percent)))


def all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components with a common prefix shingle that pass the filters."""
    other = members.select("token", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "pos", "component")])
    return as_pairs(members.join(other, "token").where((F.col("component") < F.col("component2")) & may_link(percent)))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, exhaustive_at: float = 8.0,
) -> DataFrame:
    """One row per document: the id, n_shingles, and component_id, the smallest id reachable by links, its own included.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct ``words``-word shingles (A-Z in
    lower case); a text with fewer words is one shingle. Texts without words, or null, have an empty set and no link. Rows
    without an id get a null component unless a linked row has an id; repeated rows each get their row; other columns play no
    part; an empty table gives an empty result. ``exhaustive_at``: after the first leader
    round, rounds end once the pairs left are no more than so many per member, or no longer halved; every pair left is then checked.
    """
    sizes, members = labelled(docs, F.lit(None).cast("binary"), words, percent, id_col, text_col, chunk_bytes, exhaustive_at)
    first = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = members.join(first, "component").select("cls", "component_id")
    return sizes.join(of_class, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def labelled(
    docs: DataFrame, digest: Column, words: int, percent: int, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, exhaustive_at: float = 8.0,
) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n, cls) of every row, and (cls, first_id, component) of every class of equal sets; ``digest`` is only passed on."""
    n = chunk_count(size := text_size(docs, text_col), chunk_bytes)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("chunk", chunk_of(n, "id", "text"))
    sizes = materialize(set_sizes(rows, words, n), "set-sizes")
    classes = materialize(
        sizes.where("n > 0").groupBy("cls").agg(F.min("chunk").alias("home"), F.min("id").alias("first_id")), "classes"
    )
    sets = materialize(candidates(rows.drop("digest"), classes, words, percent, size, n), "sets")
    found = materialize(link_components(sets, percent, exhaustive_at), "class-components")
    members = classes.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    return sizes, members.select("cls", "first_id", "component")


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of near duplicates one row of ``docs``, with the columns of ``docs``.

    The row with the smallest id stays, of equal ids the one with the smallest digest of its text; rows without an id take part and come
    last. Rows whose texts aren't linked all stay, with equal ids too, as do rows without words; but of rows with equal id and equal text
    one stays, the one whose columns come first as JSON. Only rows with neither id nor words all stay in any case.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    sizes, members = labelled(docs, digest, words, percent, id_col, text_col)
    rows = sizes.groupBy("id", "digest", "cls", "n").agg(F.count(F.lit(1)).alias("copies")).join(members.select("cls", "component"), "cls", "left")
    rows = materialize(rows, "labelled")
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "digest", "copies")
    winners = rows.where("n > 0").groupBy("component").agg(F.min(place).alias("w")).select("w.id", "w.digest", "w.copies")
    blank = rows.where("n = 0").select("id", "digest", F.when(F.col("id").isNull(), 1).otherwise(F.col("copies")).alias("copies"))
    keep = winners.unionByName(blank).select(F.col("id").alias("keep_id__"), F.col("digest").alias("keep__"), F.col("copies").alias("copies__"))
    keep = materialize(keep, "kept-ids")
    keyed = docs.withColumns({"id__": F.col(id_col).cast("bigint"), "digest__": digest})
    same = (F.col("digest__") == F.col("keep__")) & F.col("id__").eqNullSafe(F.col("keep_id__"))
    # the same way at every size: both joins share one exchange of the documents
    kept = keyed.join(keep.where("copies__ = 1").hint("merge"), same, "left_semi").select(*docs.columns)
    repeated = keyed.join(keep.where("copies__ > 1").hint("merge"), same, "left_semi")
    row = F.struct(*docs.columns)
    once = repeated.groupBy("id__", "digest__").agg(F.min_by(row, F.to_json(row)).alias("row__")).select("row__.*")
    return kept.unionByName(once)
