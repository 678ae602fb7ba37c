"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m bytes may stand in a document with up to k edits. Each edit spoils at most q of the item's m - q + 1 q-grams, so a
copy shares at least m - q + 1 - k q of them, and all of these lie on diagonals (place in the document minus place in the item)
within k of each other. Shared q-grams are counted in overlapping bands of 2 (k + 1) diagonals, of which one holds them all;
only bands that reach the bound are aligned. Nothing within the edit budget is lost before the alignment decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .words import U64, column_of, slices, text_bytes

Q = 8
RATE = 0.1
LEAST_BYTES = 40
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
PIECE_BYTES = 1 << 20
MATCH = StructType([
    StructField("item_id", LongType()), StructField("start", LongType()), StructField("end", LongType()), StructField("distance", LongType()),
])
ARROW_MATCH = pa.list_(pa.struct([(f.name, pa.int64()) for f in MATCH]))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case and every white space a space; places stay what they are."""
    return FOLD[data]


def q_grams(data: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each byte, as a number; none for the last q - 1 bytes."""
    if len(data) < Q:
        return np.zeros(0, U64)
    data = np.ascontiguousarray(data)
    return np.ndarray(len(data) - Q + 1, "<u8", data, strides=(1,)).copy()


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams * U64(0x9E3779B97F4A7C15)) >> U64(64 - FILTER_BITS)


@dataclass(frozen=True)
class Items:
    """Items of one block: their bytes, edit budgets and bounds, and an index from q-grams to places."""

    ids: np.ndarray
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]], rate: float) -> Items:
        texts = [folded(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
        sizes = np.array([len(t) for t in texts], np.int64)
        budget = np.minimum((sizes * rate).astype(np.int64), (sizes - Q) // Q)
        grams = [q_grams(t) for t in texts]
        flat = np.concatenate(grams)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        known = np.zeros(1 << FILTER_BITS, bool)
        known[slots(distinct)] = True
        return Items(
            np.array([i for i, _ in rows], np.int64), [t.tobytes() for t in texts], budget, sizes - Q + 1 - budget * Q, distinct,
            np.append(first, len(flat)), item[order], place[order], known,
        )


def blocks(items: DataFrame, id_col: str, text_col: str, least: int, rate: float, size: int) -> Iterator[Items]:
    """The items in blocks of at most ``size`` bytes or one item, streamed through the driver one block at a time."""
    rows, held = [], 0
    chosen = items.where(F.octet_length(text_col) >= least).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col)
    for i, t in chosen.toLocalIterator():
        if rows and held + len(t) > size:
            yield Items.of(rows, rate)
            rows, held = [], 0
        rows.append((i, t))
        held += len(t.encode())
    if rows:
        yield Items.of(rows, rate)


def bands(data: np.ndarray, doc_byte: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, band) whose shared q-grams reach the item's bound, over a run of documents."""
    grams = q_grams(data)
    at = np.flatnonzero(items.known[slots(grams)])
    number = np.minimum(np.searchsorted(items.grams, grams[at]), len(items.grams) - 1)
    same = items.grams[number] == grams[at]
    at, number = at[same], number[same]
    doc = np.searchsorted(doc_byte, at, "right") - 1
    inside = at + Q <= doc_byte[doc + 1]
    at, number, doc = at[inside], number[inside], doc[inside]
    n = items.first[number + 1] - items.first[number]
    total = int(n.sum())
    posting = np.repeat(items.first[number] - np.cumsum(n) + n, n) + np.arange(total)
    at, doc, item = np.repeat(at, n), np.repeat(doc, n), items.item[posting]
    longest = max(map(len, items.texts))
    # the place within the document, moved so that no diagonal is negative
    diagonal = at - doc_byte[doc] - items.place[posting] + longest
    cell = diagonal // (items.budget[item] + 1)
    cells = int(cell.max()) + 2 if total else 1
    key = np.sort((doc.astype(np.int64) * len(items.texts) + item) * cells + cell)
    fresh = np.append(True, key[1:] != key[:-1]) if total else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    key, count = key[heads], np.diff(np.append(heads, total))
    both = count.copy()
    follows = np.flatnonzero(np.diff(key) == 1)
    both[follows] += count[follows + 1]
    item = (key // cells) % len(items.texts)
    good = both >= items.bound[item]
    # the band that begins one cell before a full cell is covered too: its own count is checked from that cell when it has hits,
    # and holds no more than the full cell when it has none
    key, item = key[good], item[good]
    return key // cells // len(items.texts), item, key % cells


def align(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int]:
    """The least edits between the item and any part of the region, and where that part ends; budget + 1 when more are needed.

    Rows of the alignment run over the item, columns over the band of diagonals that the region leaves room for.
    """
    m, width = len(item), max(len(region) - len(item), 0) + 1 + budget
    padded = np.full(m + width, 256, np.int16)
    padded[: len(region)] = region[: m + width]
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(m):
        change = row + (padded[i : i + width] != item[i])
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        row = np.minimum.accumulate(change - step) + step
        if row.min() > budget:
            return budget + 1, 0
    ends = m + step
    row = np.where(ends <= len(region), row, budget + 1)
    best = int(row.argmin())
    return int(row[best]), m + best


def verified(doc: np.ndarray, item: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the item's copy in the document with diagonals from low to high, if it is within the budget."""
    begin, end = max(0, low - budget), min(len(doc), high + len(item) + budget)
    region = doc[begin:end]
    if (exact := region.tobytes().find(item.tobytes())) >= 0:
        return begin + exact, begin + exact + len(item), 0
    front = min(budget, len(item))  # a copy may begin up to the budget before the first diagonal
    pad = np.full(front, 255, np.uint8)
    distance, stop = align(item, np.concatenate([pad, region]), budget)
    if distance > budget or stop <= front:
        return None
    stop -= front
    back, length = align(item[::-1], np.concatenate([region[:stop][::-1], pad]), budget)
    length = min(length if back <= budget else len(item), stop)
    return begin + stop - length, begin + stop, distance


def matches(data: np.ndarray, doc_byte: np.ndarray, items: Items) -> dict[int, list[dict]]:
    """The verified matches of every document of a run; of overlapping ones of one item, the best."""
    data = folded(data)
    longest = max(map(len, items.texts))
    out: dict[int, list[dict]] = {}
    for d, i, cell in zip(*map(np.ndarray.tolist, bands(data, doc_byte, items))):
        doc = data[doc_byte[d] : doc_byte[d + 1]]
        budget = int(items.budget[i])
        low = cell * (budget + 1) - longest
        kept = out.setdefault(d, [])
        item_id = int(items.ids[i])
        if any(x["item_id"] == item_id and x["distance"] == 0 and low - budget <= x["start"] <= low + 3 * budget + 2 for x in kept):
            continue
        found = verified(doc, np.frombuffer(items.texts[i], np.uint8), budget, low, low + 2 * (budget + 1))
        if found is None:
            continue
        start, end, distance = found
        same = [x for x in kept if x["item_id"] == item_id and x["start"] < end and start < x["end"]]
        if same and min(x["distance"] for x in same) <= distance:
            continue
        for x in same:
            kept.remove(x)
        kept.append({"item_id": item_id, "start": start, "end": end, "distance": distance})
    return {d: sorted(x, key=lambda y: (y["start"], y["item_id"])) for d, x in out.items() if x}


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
    least_bytes: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES, matches_col: str = "matches",
) -> DataFrame:
    """Add ``matches`` to every row: the items that its text holds, with start and end in bytes and the number of edits.

    Case of A-Z and the kind of white space count for nothing. An item may have up to ``rate`` edits per byte, or fewer where the lemma's
    bound would reach nothing. Items under ``least_bytes``, without text or without id are not searched: too little to be evidence. Items are
    searched in blocks of ``block_bytes``, so any number will do; each block is a pass over the documents. A null or empty text has no
    matches; a text of any length is searched whole. A column named like the result is replaced; repeated rows get equal results.
    """
    out = docs.withColumn(matches_col, F.array().cast(ArrayType(MATCH)))
    names = [f.name for f in out.schema.fields if f.name != matches_col]
    schema = StructType([*[out.schema[n] for n in names], StructField(matches_col, ArrayType(MATCH))])
    for block in blocks(items, item_id, item_text, least_bytes, rate, block_bytes):
        out = out.mapInArrow(searcher(docs.sparkSession.sparkContext.broadcast(block), names, text_col, matches_col), schema)
    return out


def searcher(block, names: list[str], text_col: str, matches_col: str):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            found = batch.column(matches_col).to_pylist()
            data, offsets = text_bytes(column_of(batch, text_col))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
                part = offsets[first : last + 1] - offsets[first]
                for d, more in matches(data[offsets[first] : offsets[last]], part, block.value).items():
                    found[first + d] = (found[first + d] or []) + more
                first = last
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(found, ARROW_MATCH)], names=[*names, matches_col]
            )

    return run


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``."""
    rows = docs.select(F.struct("*").alias("row"))
    return find_leaks(rows, items, text_col="row.text", rate=rate).where(F.size("matches") == 0).select("row.*")
