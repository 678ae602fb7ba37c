"""Mixture-controlled packing: deficit round-robin over source queues fills training windows at target token proportions.

Every source is a queue of tokens: its documents one behind the other, in the order in which the encoded documents are stored.
In each window a queue earns its share of the window on top of its deficit and gives as many whole tokens; what it earned and
couldn't give yet is carried to the next window. A queue that has run dry leaves its share to the others.

Windows are filled in parallel, a block of them per task. What each queue has given before a block follows from the shares
alone: tokens leave their queues in the order of the time at which a steady flow would have finished them. The difference
from the steady flow is the deficit that the block starts with, so deficits are carried over blocks and partitions too. All
blocks hold equally many tokens, however unequal the sources are.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from siftline.session import materialize

from .tokens import narrowest, read_file, tokenizer_of
from .words import slices

WINDOW_TOKENS = 2048
#: Windows per block: two million tokens with windows of 2048.
BLOCK_WINDOWS = 1024
#: Their totals and shares are sent to every task.
MAX_SOURCES = 100_000


class Queues(NamedTuple):
    """Tokens and shares of all queues, and the time of a steady flow at which each runs dry."""

    totals: np.ndarray
    shares: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.totals.sum())

    def flowed(self, time: float) -> np.ndarray:
        return np.minimum(self.totals, self.shares * time)

    def finished(self, time: float) -> np.ndarray:
        """Tokens of each queue whose middle a steady flow has passed by then."""
        return np.minimum(self.totals, np.floor(self.shares * time + 0.5)).astype(np.int64)

    def given(self, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """What each queue has given when ``tokens`` have left all of them together, and its deficit then.

        Grows with ``tokens`` for every queue and sums to ``tokens``; of tokens that finish at one time, those of earlier queues go first.
        """
        low, high = 0.0, float((self.totals / self.shares).max(initial=0.0)) + float((1 / self.shares).max(initial=1.0))
        if tokens >= self.tokens:
            return self.totals.copy(), np.zeros(len(self.totals))
        while low < (middle := (low + high) / 2) < high:
            low, high = (low, middle) if self.finished(middle).sum() >= tokens else (middle, high)
        out, at_once = self.finished(low), self.finished(high)
        for queue in np.flatnonzero(at_once > out).tolist():
            out[queue] += min(int(at_once[queue] - out[queue]), tokens - int(out.sum()))
        return out, np.where(out < self.totals, self.flowed(high) - out, 0.0)

    def block_of(self, queue: int, position: int, size: int) -> int:
        """The block of ``size`` tokens that takes a queue's token, within one."""
        return int(self.flowed((position + 0.5) / self.shares[queue]).sum()) // size


def serve(backlog: np.ndarray, shares: np.ndarray, deficit: np.ndarray, windows: int, length: int) -> np.ndarray:
    """Deficit round-robin: what each queue (column) gives to each window (row); at the end every queue's backlog is given."""
    backlog, deficit, grants = backlog.copy(), deficit.copy(), np.zeros((windows, len(backlog)), np.int64)
    for number in range(windows):
        room = min(length, int(backlog.sum()))
        open_shares = shares * (backlog > 0)
        deficit = np.where(backlog > 0, deficit + room * open_shares / max(open_shares.sum(), 1e-300), 0.0)
        grant = np.minimum(np.floor(deficit).clip(0).astype(np.int64), backlog)
        # A round begins with another queue in each window, so that none is always the one whose earnings must wait.
        turn = np.roll(np.arange(len(backlog)), -number)
        earlier = np.cumsum(grant[turn]) - grant[turn]
        grant[turn] = np.clip(room - earlier, 0, grant[turn])
        while (left := room - int(grant.sum())) > 0:
            can = grant < backlog
            more = np.minimum(np.floor(left * shares * can / (shares * can).sum()).astype(np.int64), backlog - grant)
            if not more.any():
                first = np.argsort(np.where(can, grant - deficit, np.inf), kind="stable")[: min(left, int(can.sum()))]
                more[first] = 1
            grant += more
        grants[number], backlog, deficit = grant, backlog - grant, deficit - grant
    return grants


def encoded(docs: DataFrame, path: str, content, source: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids, its queue, its tokens, and the tokens before it in its partition and queue; stored, which fixes the order."""
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("source", StringType()), StructField("queue", StringType()), StructField("part", LongType()),
        StructField("before", LongType()), StructField("n", LongType()), StructField("ids", BinaryType()),
    ])

    def run(batches):
        side = tokenizer_of(path, content.value)
        kind, given, part_number = narrowest(max(side.size, end_id + 1)), {}, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text_"):
                queues = part.column("queue").to_pylist()
                before, sizes, ids = [], [], []
                for queue, found in zip(queues, side.ids([t or "" for t in part.column("text_").to_pylist()])):
                    ids.append(np.append(found, end_id).astype(kind).tobytes())
                    before.append(given.get(queue, 0))
                    sizes.append(len(found) + 1)
                    given[queue] = before[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), part.column("source_"), part.column("queue"), pa.array([part_number] * len(ids), pa.int64()),
                    pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ], names=schema.names)

    name = F.col(source).cast("string")
    rows = docs.select(F.col(id_col), name.alias("source_"), F.coalesce(F.concat(F.lit("v"), name), F.lit("n")).alias("queue"), F.col(text_col).alias("text_"))
    return materialize(rows.mapInArrow(run, schema), "packing-ids")


def by_block(docs: DataFrame, queues, size: int, id_col: str) -> DataFrame:
    """Documents cut at the blocks' borders: (block, queue number, position in the queue, id, source, start, tokens of the document, ids)."""
    schema = StructType([
        StructField("block", LongType()), StructField("queue", LongType()), StructField("at", LongType()), docs.schema[id_col], StructField("source", StringType()),
        StructField("start", LongType()), StructField("doc_tokens", LongType()), StructField("width", LongType()), StructField("ids", BinaryType()),
    ])

    def run(batches):
        of: Queues = queues.value
        known: dict[int, np.ndarray] = {}

        def border(block: int) -> np.ndarray:
            if block not in known:
                if len(known) > 1000:
                    known.clear()
                known[block] = of.given(block * size)[0]
            return known[block]

        def block(queue: int, position: int) -> int:
            at = of.block_of(queue, position, size)
            while border(at)[queue] > position:
                at -= 1
            while border(at + 1)[queue] <= position:
                at += 1
            return at

        for batch in batches:
            out = []
            types = (*[pa.int64()] * 3, batch.schema.field(id_col).type, pa.string(), *[pa.int64()] * 3, pa.binary())
            for row in batch.to_pylist():
                queue, at, n, ids = row["queue_number"], row["at"], row["n"], row["ids"]
                width, start, now = len(ids) // n, 0, block(queue, at)
                while start < n:
                    end = min(n, int(border(now + 1)[queue]) - at)
                    if end > start:
                        out.append((now, queue, at + start, row[id_col], row["source"], start, n, width, ids[start * width : end * width]))
                    start, now = max(start, end), now + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=schema.names)

    return docs.mapInArrow(run, schema)


def fill(of: Queues, block: int, table: pa.Table, length: int, windows: int, id_col: str) -> dict[str, list]:
    """The pieces of one block's windows, in the order of the windows."""
    size = windows * length
    (begin, deficit), (end, _) = of.given(block * size), of.given((block + 1) * size)
    grants = serve(end - begin, of.shares, deficit, windows, length)
    offsets = np.cumsum(grants, axis=1) - grants
    table = table.sort_by([("queue", "ascending"), ("at", "ascending")])
    queue_of, at = table["queue"].to_numpy(), table["at"].to_numpy()
    names = (id_col, "source", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids")
    out: dict[str, list] = {n: [] for n in names}
    keys, sources, starts, tokens, widths, parts = (table[c].to_pylist() for c in (id_col, "source", "start", "doc_tokens", "width", "ids"))
    edges = [0, *(np.flatnonzero(np.diff(queue_of)) + 1).tolist(), len(queue_of)] if len(queue_of) else []
    for x, y in zip(edges, edges[1:]):
        queue = int(queue_of[x])
        ids = np.frombuffer(b"".join(parts[x:y]), f"<u{widths[x]}").astype("<u4").tobytes()
        begins = at[x:y] - begin[queue]
        total = int(end[queue] - begin[queue])
        if begins[0] != 0 or len(ids) != 4 * total:
            raise ValueError("a block lacks tokens of a queue")
        window_ends = np.cumsum(grants[:, queue])
        cuts = np.unique(np.concatenate([begins, window_ends[window_ends < total]]))
        row = np.searchsorted(begins, cuts, "right") - 1
        window = np.searchsorted(window_ends, cuts, "right")
        ends = np.append(cuts[1:], total)
        offset = offsets[window, queue] + cuts - (window_ends[window] - grants[window, queue])
        row = row.tolist()
        out[id_col] += [keys[x + r] for r in row]
        out["source"] += [sources[x + r] for r in row]
        out["start"] += [starts[x + r] + c - b for r, c, b in zip(row, cuts.tolist(), begins[row].tolist())]
        out["length"] += (ends - cuts).tolist()
        out["doc_tokens"] += [tokens[x + r] for r in row]
        out["sequence_id"] += (block * windows + window).tolist()
        out["offset"] += offset.tolist()
        out["token_ids"] += [ids[4 * p : 4 * q] for p, q in zip(cuts.tolist(), ends.tolist())]
    return out


def pack(
    docs: DataFrame, path: str, source: str = "source", weights: Mapping[str | None, float] | None = None, length: int = WINDOW_TOKENS,
    end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per piece: id, source, start, length, doc_tokens, sequence_id, offset, token_ids.

    A document is the ids of its text and then ``end_id``; a null text is empty. Documents are cut wherever a window ends, and every id lies
    in exactly one piece; ``start`` is where the piece begins in its document, ``offset`` where it lies in its window. ``token_ids``
    has the piece's ids as little-endian unsigned 32-bit numbers. All windows but the last are full.

    ``weights`` gives the target proportion of each source (a null source is one of its own); without it, sources keep their shares of all
    tokens and run dry together. Up to the window in which a source runs dry, it has given its target within two tokens a
    window's round. Rows with equal or null ids are documents of their own; other columns play no part, whatever their names;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_file(path))
    stored = encoded(docs, path, content, source, end_id, id_col, text_col)
    runs = stored.groupBy("queue", "part").agg(F.sum("n").alias("tokens"), F.first("source").alias("name"))
    runs = materialize(runs, "packing-runs")
    sources = runs.groupBy("queue").agg(F.sum("tokens").alias("tokens"), F.first("name").alias("name")).orderBy("queue").limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = np.array([r.tokens for r in sources], np.int64)
    shares = totals.astype(float) if weights is None else np.array([weights[r.name] for r in sources], float)
    if (shares <= 0).any():
        raise ValueError("every source needs a weight above zero")
    queues = Queues(totals, shares / max(shares.sum(), 1e-300))
    sent = spark.sparkContext.broadcast(queues)
    numbers = spark.createDataFrame(pa.table({"queue": pa.array([r.queue for r in sources], pa.string()), "queue_number": pa.array(range(len(sources)), pa.int64())}))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(runs.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset")).join(numbers, "queue"), "packing-offsets")
    placed = stored.join(offsets, ["queue", "part"]).select(
        id_col, "source", "queue_number", (F.col("offset") + F.col("before")).alias("at"), "n", "ids"
    )
    cut = by_block(placed, sent, block_windows * length, id_col)
    kind = docs.schema[id_col].dataType
    schema = StructType([
        StructField(id_col, kind), StructField("source", StringType()), *[StructField(n, LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        StructField("token_ids", BinaryType()),
    ])

    def windows_of(key: tuple, table: pa.Table) -> pa.Table:
        found = fill(sent.value, key[0].as_py(), table, length, block_windows, id_col)
        types = {id_col: table.schema.field(id_col).type, "source": pa.string(), "token_ids": pa.binary()}
        return pa.table({n: pa.array(x, types.get(n, pa.int64())) for n, x in found.items()})

    return cut.groupBy("block").applyInArrow(windows_of, schema)


def padded_length(tokens: int, length: int = WINDOW_TOKENS) -> int:
    """The length that a sequence is padded to: its own at a power of two, else a whole window."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else length
