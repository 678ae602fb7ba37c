"""Ask and answer between chunks of documents and blocks of fingerprints.

Documents are dealt to chunks of a few MB by a hash of their id and text. A chunk sums up what it knows of its own documents
and sends one packed message to every block of the fingerprint space; a block merges the messages of all chunks and answers
each of them, in the order of its question. So a fingerprint that a third of all documents hold reaches its block once per
chunk, never once per document; no fingerprint of the whole corpus reaches the driver, and no task holds more than a chunk
or a block. The documents are shuffled once: all passes over the chunks have the same exchange, which Spark reuses.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "chunk bigint, block bigint, payload binary"
OWN = -1  # the block of what a chunk keeps for its next pass


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def chunk_count(size: int, chunk_bytes: int) -> int:
    return max(1, math.ceil(size / chunk_bytes))


def chunk_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).alias("chunk")


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, block, payload = zip(*rows) if rows else ((), (), ())
    return pa.table({
        "chunk": pa.array(chunk, pa.int64()), "block": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary()),
    })


def route(asks: DataFrame) -> DataFrame:
    """What a chunk keeps for itself travels under a key of its own, so that no block takes the notes of all chunks."""
    return asks.withColumn("route", F.when(F.col("block") == OWN, -1 - F.col("chunk")).otherwise(F.col("block")))


def answers(asks: DataFrame, merge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Let every block merge its messages: one answer per message, sent back to the chunk that asked."""

    def of_block(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["chunk", "block", "payload"])
        return pa.table({
            "chunk": table["chunk"], "block": table["block"],
            "payload": pa.array(merge(table["payload"].to_pylist()), pa.binary()),
        })

    return route(asks).groupBy("route").applyInArrow(of_block, MESSAGE)


def by_block(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["block"].to_pylist(), table["payload"].to_pylist()))


def cut_by_block(sorted_values: np.ndarray, block_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, from, to) of each run of equal block numbers, ascending."""
    if not len(sorted_values):
        return []
    borders = np.flatnonzero(np.diff(block_of)) + 1
    edges = [0, *borders.tolist(), len(block_of)]
    return [(int(block_of[a]), a, b) for a, b in zip(edges, edges[1:])]
