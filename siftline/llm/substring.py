"""Substring dedup: a count-min prefilter, then exact grouping of only the windows it cannot rule out.

Pass 1 counts windows in a count-min sketch of two rows: each chunk of documents makes its own sketch, blocks of the counter
space add the sketches up, and a chunk learns which of its counters reach two. Counters only ever overestimate, so a window
with a counter below two is certainly alone and none is lost. Pass 2 groups the remaining windows by a 96-bit fingerprint and
finds the smallest document that holds each. The width of the sketch grows with the texts; nothing is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .exchange import MESSAGE, OWN, answers, by_block, chunk_count, chunk_of, cut_by_block, messages, text_size
from .words import (
    U64, mix, pack, pack_flags, pack_sorted, pieces, unpack, unpack_flags, unpack_sorted, window_starts, window_values, word_values,
)

CHUNK_BYTES = 4 << 20
BLOCK_BITS = 23
SECOND = U64(0xA0761D6478BD642F)  # makes a second, independent value of a word from its first
LAST = np.iinfo(np.int64).max  # stands for a missing id: later than every other


def chunk_windows(table: pa.Table, length: int):
    """Per chunk: the distinct windows (two fingerprints, ascending), how often and in which first document each stands.

    Also the pieces with the places of their windows, and the number and the document of each window.
    """
    ids = table["id"].to_numpy(zero_copy_only=False) if not table["id"].null_count else table["id"].fill_null(LAST).to_numpy()
    found, first, second, owner = [], [], [], []
    for piece in pieces(table["text"]):
        starts = window_starts(piece, length)
        found.append((piece, starts))
        if not len(starts):
            continue
        words = word_values(piece, 1)
        first.append(window_values(words, length)[starts])
        second.append(window_values(mix(words ^ SECOND), length)[starts] >> U64(32))
        docs = np.repeat(ids[piece.first : piece.first + piece.docs], piece.counts())
        owner.append(docs[starts])
    if not first:
        none = np.zeros(0, U64)
        return found, none, none, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second, owner = np.concatenate(first), np.concatenate(second), np.concatenate(owner).astype(np.int64)
    order, fresh = grouped(first, second)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    several = np.diff(np.append(heads, len(order))) > 1
    at = order[heads]
    return found, first[at], second[at], np.minimum.reduceat(owner[order], heads), several, number, owner


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where each group begins."""
    order = np.argsort(first)
    f, s = first[order], second[order]
    fresh = np.ones(len(f), bool)
    same, differ = f[1:] == f[:-1], s[1:] != s[:-1]
    if (same & differ).any():
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        same, differ = f[1:] == f[:-1], s[1:] != s[:-1]
    fresh[1:] = ~same | differ
    return order, fresh


def counters(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a window in the two rows of the sketch; the second row stands behind the first."""
    other = (first * U64(0x9E3779B97F4A7C15)) ^ (second << U64(29))
    other = other * U64(0xBF58476D1CE4E5B9)
    return first >> U64(64 - bits), (other >> U64(64 - bits)) + U64(1 << bits)


def sketch_messages(chunk: int, first: np.ndarray, second: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    out = []
    for row in counters(first, second, bits):
        row = distinct_sorted(row)
        for block, a, b in cut_by_block(row, row >> U64(BLOCK_BITS)):
            out.append((chunk, block, pack_sorted(row[a:b] & U64((1 << BLOCK_BITS) - 1))))
    return out


def distinct_sorted(row: np.ndarray) -> np.ndarray:
    row = np.sort(row)
    return row[np.append(True, row[1:] != row[:-1])] if len(row) else row


def merge_sketches(payloads: list[bytes]) -> list[bytes]:
    """Which counters of each sketch another sketch counts too. A sketch knows itself what it counts twice."""
    once, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
    asked = []
    for payload in payloads:
        at = unpack_sorted(payload).astype(np.int64)
        twice[at] |= once[at]
        once[at] = True
        asked.append(at)
    return [pack_flags(twice[at]) for at in asked]


def repeated(first, second, several, bits: int, got: dict[int, bytes]) -> np.ndarray:
    """The windows whose counters all reach two."""
    hot = np.ones(len(first), bool)
    for number, row in enumerate(counters(first, second, bits)):
        order = np.argsort(row) if number else np.arange(len(row))
        row = row[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = row[1:] != row[:-1]
        heads = np.flatnonzero(fresh)
        twice = np.diff(np.append(heads, len(row))) > 1
        distinct = row[heads]
        for block, a, b in cut_by_block(distinct, distinct >> U64(BLOCK_BITS)):
            twice[a:b] |= unpack_flags(got[block])
        hot[order] &= twice[np.cumsum(fresh) - 1]
    return hot | several


def merge_windows(payloads: list[bytes]) -> list[bytes]:
    """Whether a smaller document than the asking chunk's own first one holds each window."""
    parts = [split3(p) for p in payloads]
    f, s, o = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order, fresh = grouped(f, s)
    smaller = np.empty(len(f), bool)
    if len(f):
        o = o[order]
        smaller[order] = np.minimum.reduceat(o, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] < o
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [pack_flags(x) for x in np.split(smaller, cuts)]


def join3(f: np.ndarray, s: np.ndarray, o: np.ndarray) -> bytes:
    a, b, c = pack_sorted(f), pack(s), pack((o - np.int64(-(2**63))).view(U64) if len(o) and o.min() < 0 else o.astype(U64))
    head = np.array([len(a), len(b), int(len(o) and o.min() < 0)], np.int64).tobytes()
    return head + a + b + c


def split3(p: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, shifted = map(int, np.frombuffer(p, np.int64, 3))
    o = unpack(p[24 + n + m :])
    o = (o + U64(2**63)).view(np.int64) if shifted else o.view(np.int64)
    return unpack_sorted(p[24 : 24 + n]), unpack(p[24 + n : 24 + n + m]), o


def drop_repeated(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
    chunk_bytes: int = CHUNK_BYTES, load: float = 0.25,
) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also begins in a document with a smaller id.

    Returns one row per input row: the id, n_words, n_removed, and kept_text, the remaining words joined by one space; with
    ``carry`` also the text as it was, and ``rest``, a struct of the input's other columns. Windows are judged on the input. ``load`` is the share of
    counters in use per row of the sketch. Whole texts count. A null text has no words; a null id counts as larger than every
    other; rows with the same id are never a source for each other; other columns play no part, whatever their names; an empty
    table gives an empty result. A task holds one chunk: ``chunk_bytes`` or one document, whichever is more.
    """
    n = chunk_count(size := text_size(docs, text_col), chunk_bytes)
    bits = min(62, max(BLOCK_BITS, math.ceil(math.log2(max(1, size / 6) / load))))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    blocks = -(-n // 8)  # of windows to be grouped, which are a small part of all
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[others.alias("rest")] * carry
    ).withColumn("chunk", chunk_of(n, "id", "text"))

    def ask_sketch(key, table):
        _, first, second, *_ = chunk_windows(table, length)
        return messages(sketch_messages(key[0].as_py(), first, second, bits))

    def ask_windows(key, table, got):
        chunk = key[0].as_py()
        _, first, second, owner, several, *_ = chunk_windows(table, length)
        hot = repeated(first, second, several, bits, by_block(got))
        out = [(chunk, OWN, pack_flags(hot))]
        first, second, owner = first[hot], second[hot], owner[hot]
        for block, a, b in cut_by_block(first, block_number(first, blocks)):
            out.append((chunk, block, join3(first[a:b], second[a:b], owner[a:b])))
        return messages(out)

    def finish(key, table, got):
        found, first, second, least, several, number, owner = chunk_windows(table, length)
        got = by_block(got)
        at = np.flatnonzero(unpack_flags(got[OWN])) if OWN in got else np.zeros(0, np.int64)
        elsewhere = np.zeros(len(first), bool)
        for block, a, b in cut_by_block(first[at], block_number(first[at], blocks)):
            elsewhere[at[a:b]] = unpack_flags(got[block])
        return kept_words(table, found, elsewhere[number] | (owner > least[number]), length)

    asks = rows.groupBy("chunk").applyInArrow(ask_sketch, MESSAGE)
    counted = answers(asks, merge_sketches)
    asks = rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(ask_windows, MESSAGE)
    grouped = answers(asks, merge_windows)
    schema = StructType.fromDDL("id bigint, n_words bigint, n_removed bigint, kept_text string")
    if carry:
        schema.add("text", "string").add(rows.schema["rest"])
    out = rows.groupBy("chunk").cogroup(grouped.groupBy("chunk")).applyInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text; a document that loses nothing stays as it is.

    A document that is all repeats keeps its row, with an empty text.
    """
    found = drop_repeated(docs, length, text_col=text_col, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def block_number(first: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a window: an even share of the fingerprint space."""
    return ((first >> U64(32)) * U64(blocks)) >> U64(32)


def kept_words(table: pa.Table, found, gone: np.ndarray, length: int) -> pa.Table:
    words, removed, texts, at = [], [], [], 0
    for piece, starts in found:
        flags = gone[at : at + len(starts)]
        at += len(starts)
        cover = np.zeros(len(piece.starts) + 1, np.int32)
        cover[starts[flags]] += 1
        cover[starts[flags] + length] -= 1
        out = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(out)])
        removed.append(sums[piece.doc_word[1:]] - sums[piece.doc_word[:-1]])
        words.append(piece.counts())
        texts.append(join_words(piece, ~out))
    none = np.zeros(0, np.int64)
    carried = {c: table[c] for c in ("text", "rest")} if "rest" in table.column_names else {}
    return pa.table({
        "id": table["id"], "n_words": np.concatenate(words or [none]).astype(np.int64),
        "n_removed": np.concatenate(removed or [none]).astype(np.int64),
        "kept_text": pa.chunked_array(texts, pa.string()), **carried,
    })


def join_words(piece, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    starts, ends = piece.starts[keep], piece.ends[keep]
    doc_word = np.concatenate([[0], np.cumsum(keep)])[piece.doc_word]
    sizes = ends - starts + 1
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    source = np.repeat(starts - begin, sizes) + np.arange(total)
    data = np.append(piece.data, np.uint8(32))[np.minimum(source, len(piece.data))] if total else np.zeros(0, np.uint8)
    data[begin + sizes - 1] = 32
    last = doc_word[1:][doc_word[1:] > doc_word[:-1]] - 1
    inside = np.ones(total, bool)
    inside[(begin + sizes - 1)[last]] = False
    per_doc = np.concatenate([[0], np.cumsum(sizes)])[doc_word] - np.concatenate([[0], np.cumsum(doc_word[1:] > doc_word[:-1])])
    data = data[inside]
    return pa.StringArray.from_buffers(len(per_doc) - 1, pa.py_buffer(per_doc.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
