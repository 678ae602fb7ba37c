"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked id pairs under a minimal perfect hash.

Where the tokens of both sides end at the same byte, a group ends; all tokens of a group are linked. The first pass encodes
the documents and keeps their ids in chunks; every chunk counts, by distinct pair, its documents that hold the pair linked.
The distinct pairs of all chunks are united by a tree and get a minimal perfect hash per bucket of the pair space. The chunks'
counts become dense vectors indexed by that hash, which are summed by a tree. The second pass aligns the kept ids anew and
looks up the counts; a key kept at each index verifies every lookup.

Buckets divide the first tokenizer's ids, so a bucket sees all pairs of an id; the two vocabularies bound its size. Chunks
hold a bounded number of pairs. So no task's memory grows with the corpus, and nothing is sent to the driver but totals.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftline.session import materialize

from .perfect_hash import PerfectHash
from .tokens import narrowest, read_file, tokenizer_of
from .words import U64, column_of, mix, slices

BUCKETS = 256
#: Pairs, one per document and distinct pair, after which a chunk is closed.
CHUNK_PAIRS = 1_500_000
#: Bytes of the chunks' messages that one step of a tree takes at most, about.
STEP_BYTES = 32 << 20
FAN_IN = 16
LINKS_AT_ONCE = 1 << 18
#: Bytes of text, or of compressed A ids, that are aligned together.
TEXT_BYTES = 1 << 19
IDS_BYTES = 1 << 17
#: All pairs must be below this, so that a pair and a document's place fit one 64-bit number.
MAX_UNIVERSE = 1 << 42

KEYS = "bucket int, part bigint, keys binary"
VECTORS = "bucket int, part bigint, counts binary"
TABLE = "bucket int, hash binary, keys binary, counts binary"
ANSWERS = "chunk bigint, keys binary, found binary"


class Aligned(NamedTuple):
    """Tokens of a run of documents, laid end to end, and the groups that hold them."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    doc: np.ndarray  # of each group

    @property
    def groups(self) -> int:
        return len(self.doc)


def align(a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, bytes_a: np.ndarray, bytes_b: np.ndarray) -> Aligned:
    """Group tokens by common ends. ``rows_a`` is each A token's document; both sides of each document cover the same bytes."""
    ends_a, ends_b = np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b])
    common = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a if len(b) else np.zeros(len(a), bool)
    borders = ends_a[common]
    return Aligned(a, b, np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b), rows_a[common])


def links(of: Aligned, size_b: int, at_once: int = LINKS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(pair, document, times) of all links, about ``at_once`` at a time; a pair is a * size_b + b.

    A group with more links than that is taken by its distinct ids, in rows of A ids, each pair with the number of its links.
    """
    n_a, n_b = np.bincount(of.group_a, minlength=of.groups), np.bincount(of.group_b, minlength=of.groups)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    per_group = n_a * n_b
    usual = np.flatnonzero(per_group <= at_once)
    ends = np.cumsum(per_group[usual])
    low = 0
    while low < len(usual):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + at_once, "right")))
        g = np.repeat(usual[low:high], per_group[usual[low:high]])
        inside = np.arange(len(g)) - np.repeat(ends[low:high] - per_group[usual[low:high]] - done, per_group[usual[low:high]])
        row = inside // n_b[g]
        pair = of.a[first_a[g] + row].astype(U64) * U64(size_b) + of.b[first_b[g] + inside - row * n_b[g]].astype(U64)
        yield pair, of.doc[g], None
        low = high
    for g in np.flatnonzero(per_group > at_once).tolist():
        ids_a, times_a = np.unique(of.a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(of.b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        step = max(1, at_once // len(ids_b))
        for i in range(0, len(ids_a), step):
            pair = (ids_a[i : i + step].astype(U64) * U64(size_b))[:, None] + ids_b.astype(U64)[None, :]
            times = times_a[i : i + step][:, None] * times_b[None, :]
            yield pair.ravel(), np.full(pair.size, of.doc[g]), times.ravel()


def pairs_by_document(of: Aligned, size_a: int, size_b: int) -> np.ndarray:
    """The distinct pairs of each document, one number per document and pair, ascending by document."""
    universe = U64(size_a * size_b)
    found = [np.unique(doc.astype(U64) * universe + pair) for pair, doc, _ in links(of, size_b)]
    return np.zeros(0, U64) if not found else found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def bucket_of(pairs: np.ndarray, size_b: int, buckets: int) -> np.ndarray:
    return (mix(pairs // U64(size_b)) % U64(buckets)).astype(np.int64)


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end as 64-bit numbers, and the row of each element."""
    sizes = [len(p) for p in parts]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.repeat(np.arange(len(parts)), sizes)


def joined_bytes(ids: np.ndarray, rows: np.ndarray, n: int, tokens: pa.Array) -> list[bytes]:
    """The bytes of each row's tokens; ``rows`` ascends."""
    taken = tokens.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], "<i8")[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    at = offsets[np.searchsorted(rows, np.arange(n + 1))].tolist()
    data = memoryview(taken.buffers()[2]) if len(ids) and taken.buffers()[2] is not None else memoryview(b"")
    return [data[x:y].tobytes() for x, y in zip(at, at[1:])]


def group_texts(of: Aligned, rows_a: np.ndarray, rows_b: np.ndarray, n: int, table: pa.Array, size_a: int, size_b: int) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``. ``table`` has every id with every sign that may follow it."""
    last_a, last_b = np.ones(len(of.a), bool), np.ones(len(of.b), bool)
    last_a[:-1] = of.group_a[1:] != of.group_a[:-1]
    last_b[:-1] = of.group_b[1:] != of.group_b[:-1]
    starts_b = np.searchsorted(of.group_b, of.group_a)  # B tokens of earlier groups
    ends_a = np.searchsorted(of.group_a, of.group_b, "right")
    order = np.empty(len(of.a) + len(of.b), np.int64)
    rows = np.empty(len(order), np.int64)
    at_a, at_b = np.arange(len(of.a)) + starts_b, np.arange(len(of.b)) + ends_a
    order[at_a], rows[at_a] = of.a + np.where(last_a, size_a, 0), rows_a
    order[at_b], rows[at_b] = of.b + np.where(last_b, 2 * size_a + size_b, 2 * size_a), rows_b
    return [t[:-1] for t in joined_bytes(order, rows, n, table)]


@functools.lru_cache(maxsize=2)
def signs(size_a: int, size_b: int) -> pa.Array:
    """The strings that ``group_texts`` puts together."""
    parts = [f"{i}{s}".encode() for size, pair in ((size_a, ",|"), (size_b, ",;")) for s in pair for i in range(size)]
    return pa.array(parts, pa.large_binary())


class Sides(NamedTuple):
    """The two tokenizers of a worker."""

    a: object
    b: object

    def aligned(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """The alignment of documents' ids, and the row of each token."""
        ids_a, rows_a = flat(a)
        ids_b, rows_b = flat(b)
        return align(ids_a, ids_b, rows_a, self.a.lengths, self.b.lengths), rows_a, rows_b

    def encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a text is empty or the bytes of a side aren't those of a space and the text."""
        none = np.zeros(0, np.uint32)
        at = [i for i, t in enumerate(texts) if t]
        a, b = [none] * len(texts), [none] * len(texts)
        found_a, found_b = self.a.ids([" " + texts[i] for i in at]), self.b.ids([texts[i] for i in at])
        joined = [
            joined_bytes(*flat(found), len(at), side.tokens)
            for side, found in ((self.a, found_a), (self.b, found_b))
        ]
        for i, x, y, p, q in zip(at, found_a, found_b, *joined):
            if p == q == (" " + texts[i]).encode("utf-8", "surrogatepass"):
                a[i], b[i] = x, y
        return a, b


class Files(NamedTuple):
    """Names and contents of the two vocabulary files."""

    path_a: str
    content_a: bytes
    path_b: str
    content_b: bytes

    def sides(self) -> Sides:
        return Sides(tokenizer_of(self.path_a, self.content_a), tokenizer_of(self.path_b, self.content_b))


def counted(keys: np.ndarray, chunk: int, size_b: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, pairs, numbers of documents) of a chunk, a row per bucket."""
    pairs, counts = np.unique(keys, return_counts=True)
    of = bucket_of(pairs, size_b, buckets)
    order = np.argsort(of, kind="stable")
    pairs, counts, of = pairs[order], counts[order], of[order]
    borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for x, y in zip(borders, borders[1:]):
        if y > x:
            yield int(of[x]), pairs[x:y].astype("<u8").tobytes(), counts[x:y].astype("<i8").tobytes()


def first_pass(docs: DataFrame, files, id_col: str, text_col: str, buckets: int, chunk_pairs: int) -> DataFrame:
    """Rows of two kinds: a document's ids and its chunk, and a chunk's counts of one bucket of pairs."""
    kept = StructField(id_col, docs.schema[id_col].dataType)
    schema = StructType([kept, StructField("chunk", LongType()), *[StructField(n, BinaryType()) for n in ("a", "b")],
                         StructField("bucket", LongType()), *[StructField(n, BinaryType()) for n in ("keys", "counts")]])

    def run(batches):
        sides = files.value.sides()
        size_a, size_b = sides.a.size, sides.b.size
        type_a, type_b = narrowest(size_a), narrowest(size_b)
        universe = U64(size_a * size_b)
        chunk, waiting, n_waiting = TaskContext.get().partitionId() << 32, [], 0

        def messages() -> pa.RecordBatch:
            rows = list(counted(np.concatenate(waiting), chunk, size_b, buckets))
            of, keys, counts = zip(*rows) if rows else ((), (), ())
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.nulls(n, column_type), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                pa.array(of, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()),
            ], names=schema.names)

        column_type = None
        for batch in batches:
            column_type = batch.column(id_col).type
            for part in slices(batch, text_col, TEXT_BYTES):
                a, b = sides.encoded(part.column(text_col).to_pylist())
                found = pairs_by_document(sides.aligned(a, b)[0], size_a, size_b)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), pa.array([chunk] * n, pa.int64()),
                    squeezed(a, type_a), squeezed(b, type_b),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ], names=schema.names)
                waiting.append(found % universe)
                n_waiting += len(found)
                if n_waiting >= chunk_pairs:
                    yield messages()
                    chunk, waiting, n_waiting = chunk + 1, [], 0
                    pa.default_memory_pool().release_unused()
        if n_waiting:
            yield messages()

    return materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "align-ids")


def numbers(column: pa.Array | pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def squeezed(ids: list[np.ndarray], kind: str) -> pa.Array:
    """Each document's ids, compressed: they are the largest part of what is stored and shuffled."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(x.astype(kind).tobytes()) if len(x) else b"" for x in ids], pa.binary())


def unsqueezed(column: pa.Array, kind: str) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(x) if x else b"", kind) for x in column.to_pylist()]


def one_row(key: tuple, schema: str, *payload: bytes) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    head = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64())]
    return pa.table([*head, *[pa.array([x], pa.binary()) for x in payload]], names=names)


def united(messages: DataFrame, parts: int) -> DataFrame:
    """The distinct pairs of each bucket, by a tree over the parts."""

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        return one_row(key, KEYS, np.unique(np.concatenate(numbers(table["keys"], "<u8"))).astype("<u8").tobytes())

    found = messages.select("bucket", "part", "keys").groupBy("bucket", "part").applyInArrow(unite, KEYS)
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("bucket", "part").applyInArrow(unite, KEYS)
    return found


def hashed(keys: DataFrame) -> DataFrame:
    """A minimal perfect hash per bucket, and the bucket's pairs by index."""

    def build(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for keys in numbers(batch.column("keys"), "<u8"):
                made = PerfectHash.build(keys)
                by_index = np.empty(len(keys), "<u8")
                by_index[made.index(keys)] = keys
                found.append((made.pack(), by_index.tobytes()))
            yield pa.RecordBatch.from_arrays([
                batch.column("bucket"), *[pa.array(x, pa.binary()) for x in zip(*found)],
            ], names=["bucket", "hash", "keys"])

    return keys.select("bucket", "keys").mapInArrow(build, "bucket int, hash binary, keys binary")


def for_parts(table: DataFrame, parts: int) -> DataFrame:
    return table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))


def summed(messages: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """Dense vectors of the chunks' counts, indexed by the hash and summed by a tree."""

    def dense(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made, by_index = PerfectHash.unpack(right["hash"][0].as_py()), np.frombuffer(right["keys"][0].as_py(), "<u8")
        total = np.zeros(len(by_index), np.int64)
        for keys, counts in zip(numbers(left["keys"], "<u8"), numbers(left["counts"], "<i8")):
            total[checked(made, keys, by_index)] += counts  # a message has distinct keys
        return one_row(key, VECTORS, total.tobytes())

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        return one_row(key, VECTORS, np.sum(numbers(rows["counts"], "<i8"), axis=0, dtype=np.int64).tobytes())

    by = ["bucket", "part"]
    found = messages.groupBy(*by).cogroup(for_parts(table, parts).groupBy(*by)).applyInArrow(dense_of(dense), VECTORS)
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts))).groupBy(*by).applyInArrow(add, VECTORS)
    return found


def dense_of(function):
    """A part of a bucket that no chunk has a message for adds nothing."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        return function(key, left, right)

    return run


def checked(made: PerfectHash, keys: np.ndarray, by_index: np.ndarray) -> np.ndarray:
    at = made.verified(keys, by_index)
    if (at < 0).any():
        raise ValueError("a pair is missing from the hash of all pairs")
    return at


def answered(messages: DataFrame, table: DataFrame, parts: int, size_b: int) -> DataFrame:
    """To each chunk its pairs with twice their count, plus one for the highest count of the pair's A id."""

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "found": pa.array([], pa.binary())})
        made = PerfectHash.unpack(right["hash"][0].as_py())
        by_index, counts = (np.frombuffer(right[c][0].as_py(), t) for c, t in (("keys", "<u8"), ("counts", "<i8")))
        ids, row = np.unique(by_index // U64(size_b), return_inverse=True)
        highest = np.zeros(len(ids), np.int64)
        np.maximum.at(highest, row, counts)
        found = 2 * counts + (counts == highest[row])
        out = [found[checked(made, keys, by_index)].astype("<i8").tobytes() for keys in numbers(left["keys"], "<u8")]
        return pa.table({"chunk": left["chunk"], "keys": left["keys"], "found": pa.array(out, pa.binary())})

    by = ["bucket", "part"]
    return messages.groupBy(*by).cogroup(for_parts(table, parts).groupBy(*by)).applyInArrow(look_up, ANSWERS)


def second_pass(ids: DataFrame, answers: DataFrame, files, id_col: str) -> DataFrame:
    """Align the kept ids of each chunk again and look up what its pairs count."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = StructType([ids.schema[id_col], *[StructField(n, LongType()) for n in names], StructField("groups", BinaryType())])

    def of_chunk(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        sides = files.value.sides()
        size_a, size_b = sides.a.size, sides.b.size
        table = signs(size_a, size_b)
        keys = np.concatenate([np.zeros(0, U64), *numbers(found["keys"], "<u8")])
        values = np.concatenate([np.zeros(0, np.int64), *numbers(found["found"], "<i8")])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for batch in docs.combine_chunks().to_batches():
            for part in slices(batch, "a", IDS_BYTES):
                n = part.num_rows
                a, b = unsqueezed(part.column("a"), narrowest(size_a)), unsqueezed(part.column("b"), narrowest(size_b))
                of, rows_a, rows_b = sides.aligned(a, b)
                sums = np.zeros((3, n), np.int64)
                for pair, doc, times in links(of, size_b):
                    value = values[np.searchsorted(keys, pair)]
                    times = np.ones(len(pair), np.int64) if times is None else times
                    borders = np.searchsorted(doc, np.arange(n + 1))
                    for row, x in enumerate((times, times * (value & 1), times * (value >> 1))):
                        sums[row] += np.diff(np.concatenate([[0], np.cumsum(x)])[borders])
                per_doc = [np.bincount(r, minlength=n).astype(np.int64) for r in (rows_a, rows_b, of.doc)]
                texts = group_texts(of, rows_a, rows_b, n, table, size_a, size_b)
                out.append(pa.Table.from_arrays(
                    [part.column(id_col), *[pa.array(x) for x in (*per_doc, *sums)], pa.array(texts, pa.binary())], names=schema.names,
                ))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out) if out else docs.select([id_col]).slice(0, 0)

    return ids.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of_chunk, schema)


def align_corpus(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    chunk_pairs: int = CHUNK_PAIRS, step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A (byte level) encodes a space and the text, B (word pieces, which adds the space) the text; strings of special tokens are
    plain text. ``groups`` has the ids as ``a1,a2|b1;a3|b2,b3`` in ASCII bytes. ``n_links`` counts all pairs of an A and a B token
    of one group. A pair's count is the number of documents of the table that hold it linked; ``count_sum`` adds the counts over
    the links, ``n_best`` counts the links whose count no other pair of the same A id exceeds (ties all count).

    A document whose text is null or empty, or whose tokens of either side don't spell a space and the text, has no tokens:
    zeros and empty groups; it counts for no pair. Rows with equal or null ids are documents of their own. Other columns play
    no part, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    files = Files(path_a, read_file(path_a), path_b, read_file(path_b))
    sides = files.sides()
    if sides.a.size * sides.b.size > MAX_UNIVERSE:
        raise ValueError("the vocabularies are too large for pairs of 42 bits")
    sent = spark.sparkContext.broadcast(files)
    rows = first_pass(docs, sent, id_col, text_col, buckets, chunk_pairs)
    messages = rows.where("bucket is not null").select(F.col("bucket").cast("int").alias("bucket"), "chunk", "keys", "counts")
    size = messages.agg(F.sum(F.octet_length("keys") + F.octet_length("counts")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(size / (buckets * step_bytes)))
    messages = messages.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
    hashes = materialize(hashed(united(messages, parts)), "align-hash")
    vectors = summed(messages, hashes, parts).select("bucket", "counts")
    table = materialize(hashes.join(vectors, "bucket"), "align-counts")
    answers = answered(messages, table, parts, sides.b.size)
    return second_pass(rows.where("bucket is null").select(id_col, "chunk", "a", "b"), answers, sent, id_col)
