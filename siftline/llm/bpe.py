"""Byte-level BPE with a hierarchical-bitmap rank queue.

The positions of mergeable pairs wait in one bucket per merge rank; a bitmap of two levels over the ranks finds the lowest
bucket in use by find-first-set. A merge relinks its neighbours and moves their pairs to other buckets; entries left behind
are recognised as stale and skipped when their bucket is read. A pre-token of n bytes takes O(n) bucket moves, so a run of a
million equal letters is no worse than as many short words. Many pre-tokens share one queue: their linked lists lie end to
end and have ends of their own, so the queue is set up once for all pre-tokens of a batch that aren't known yet.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .words import slices

#: Pre-tokens in a generation of a worker's cache, about 200 bytes each.
CACHED = 120_000
CACHED_CHARS = 40
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of pre-tokens in one queue; a longer pre-token has a queue of its own.
QUEUE_BYTES = 1 << 18
TEXT_BYTES = 1 << 20

#: White space as Unicode defines it, in place of the pattern's \s, which also takes the separators 1C-1F here.
SPACE = r"[\t-\r \x85\xa0  -     　]"



def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class RankQueue:
    """The merges of one vocabulary."""

    known: dict[str, RankQueue] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(ranks.values(), default=0).bit_length()
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.byte_pair = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = rank
        self.bit = [1 << i for i in range(max(256, (max(ranks.values(), default=0) >> 8) + 1))]

    @classmethod
    def of(cls, path: str, ranks: dict[bytes, int]) -> RankQueue:
        """A worker's queue for a vocabulary file."""
        if path not in cls.known:
            cls.known.clear()
            cls.known[path] = cls(ranks)
        return cls.known[path]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token: always its lowest rank first, and of equal ranks the leftmost."""
        out, first, size = [], 0, 0
        for i, piece in enumerate(pieces):
            if size and size + len(piece) > QUEUE_BYTES:
                out += self._merged(pieces[first:i])
                first, size = i, 0
            size += len(piece)
        return out + self._merged(pieces[first:]) if size else out

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.append(0, ends[:-1])
        tokens = self.byte[data]
        if (tokens < 0).any():
            raise KeyError(f"the vocabulary lacks the byte {data[np.argmin(tokens)]}")
        ranks = np.full(len(data), -1, np.int64)
        ranks[:-1] = self.byte_pair[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[starts] = -1, -1
        order = np.argsort(ranks, kind="stable")[int((ranks < 0).sum()) :]
        values, begins = np.unique(ranks[order], return_index=True)
        parts = np.split(order, begins[1:]) if len(order) else []
        buckets = {rank: part.tolist() for rank, part in zip(values.tolist(), parts)}
        merged = np.array(self._run(tokens.tolist(), ranks.tolist(), after.tolist(), before.tolist(), buckets))
        alive = merged >= 0
        ids = merged[alive].astype("<u4").tobytes()
        at = (4 * np.append(0, np.cumsum(alive)[ends - 1])).tolist()
        return [ids[x:y] for x, y in zip(at, at[1:])]

    def _run(self, tokens: list[int], waiting: list[int], follows: list[int], before: list[int], buckets: dict[int, list[int]]) -> list[int]:
        """Merge until no bucket is left; merged-away positions hold -1 at the end.

        ``low`` and ``high`` are the levels of the bitmap: 256 buckets per word of ``low``, and a bit of ``high`` per word in use.
        """
        get, shift, bit = self.pairs.get, self.shift, self.bit
        low: dict[int, int] = {}
        high = 0
        for rank in buckets:
            low[rank >> 8] = low.get(rank >> 8, 0) | bit[rank & 255]
        for word in low:
            high |= bit[word]
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            lowest = bits & -bits
            rank = word << 8 | lowest.bit_length() - 1
            bucket = buckets.pop(rank)
            low[word] = bits = bits ^ lowest
            if not bits:
                high ^= bit[word]
            bucket.sort()
            for done, i in enumerate(bucket, 1):
                if waiting[i] != rank:
                    continue
                gone = follows[i]
                tokens[i], tokens[gone], waiting[gone] = rank, -1, -1
                after = follows[i] = follows[gone]
                left, new, other = before[i], -1, -1
                if after >= 0:
                    before[after] = i
                    new = get(rank << shift | tokens[after], -1)
                waiting[i] = new
                if left >= 0:
                    waiting[left] = other = get(tokens[left] << shift | rank, -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        word = new >> 8
                        low[word] = low.get(word, 0) | bit[new & 255]
                        high |= bit[word]
                if other >= 0:
                    if other in buckets:
                        buckets[other].append(left)
                    else:
                        buckets[other] = [left]
                        word = other >> 8
                        low[word] = low.get(word, 0) | bit[other & 255]
                        high |= bit[word]
                if -1 < new < rank or -1 < other < rank:  # a lower rank goes first; the rest of the bucket waits
                    if done < len(bucket):
                        buckets[rank] = bucket[done:]
                        word = rank >> 8
                        low[word] = low.get(word, 0) | bit[rank & 255]
                        high |= bit[word]
                    break
        return tokens


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return np.frombuffer(RankQueue(ranks).ids([piece])[0], "<u4").tolist()


class PieceIds:
    """Packed ids by pre-token. A worker keeps short pre-tokens from task to task: at most two generations of ``cached`` each."""

    known: dict[tuple[str, int], PieceIds] = {}

    def __init__(self, queue: RankQueue, cached: int):
        self.queue, self.cached, self.now, self.older = queue, cached, {}, {}

    @classmethod
    def of(cls, path: str, ranks: dict[bytes, int], cached: int) -> PieceIds:
        if (path, cached) not in cls.known:
            cls.known.clear()
            cls.known[path, cached] = cls(RankQueue.of(path, ranks), cached)
        return cls.known[path, cached]

    def find(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of all distinct pre-tokens of a batch: those known already, whole tokens, and the rest through one queue."""
        found, missing, now, older = {}, [], self.now, self.older
        for piece in set(pieces):
            ids = now.get(piece)
            if ids is None and (ids := older.get(piece)) is None:
                missing.append(piece)
            else:
                found[piece] = ids
        packed = [p.encode("utf-8", "surrogatepass") for p in missing]
        whole = [self.queue.ranks.get(p) for p in packed]
        through = iter(self.queue.ids([p for p, w in zip(packed, whole) if w is None and p]))
        for piece, text, rank in zip(missing, packed, whole):
            found[piece] = rank.to_bytes(4, "little") if rank is not None else next(through) if text else b""
        if len(now) >= self.cached:
            self.older, self.now = now, {}
        for piece in missing:
            if len(piece) <= CACHED_CHARS and len(self.now) < self.cached:
                self.now[piece] = found[piece]
        return found


def small_ranks(path: str) -> dict[bytes, int]:
    ranks = read_ranks(path)
    if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY_BYTES} bytes and can't be sent to every task")
    return ranks


def added(df: DataFrame, *fields: StructField) -> tuple[StructType, list[str]]:
    """The schema with new columns at its end, and the columns kept; columns with the new names are replaced."""
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return StructType([*kept, *fields]), [f.name for f in kept]


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens",
    bytes_col: str | None = None, cached: int = CACHED,
) -> DataFrame:
    """Add the token ids of whole texts, as little-endian unsigned 32-bit numbers, and their count.

    ``pattern`` splits a text into pre-tokens; text that it doesn't match is left out, as in the usual encoders. A null or
    empty text has no tokens. There are no special tokens: their strings are ordinary text. With ``bytes_col``, the ids are decoded again on
    the spot, as ``decode`` does. ``cached`` bounds the pre-tokens that a worker keeps; it changes no result. Other columns stay; one named like
    a new column is replaced. Rows are independent of each other, so repeats, ties and empty tables need no rule.
    """
    ranks = df.sparkSession.sparkContext.broadcast(small_ranks(ranks_path))
    back = [StructField(bytes_col, BinaryType())] if bytes_col else []
    schema, kept = added(df, StructField(ids_col, BinaryType()), StructField(count_col, LongType()), *back)

    def run(batches):
        split = regex.compile(pattern.replace(r"\s", SPACE).replace("[^" + SPACE, "[^" + SPACE[1:-1]))
        ids = PieceIds.of(ranks_path, ranks.value, cached)
        token = token_bytes(ranks.value)
        for batch in (part for whole in batches for part in slices(whole, text_col, TEXT_BYTES)):
            pieces = [split.findall(t) if t else [] for t in batch.column(text_col).to_pylist()]
            known = ids.find(chain.from_iterable(pieces))
            found = [b"".join(map(known.__getitem__, p)) for p in pieces]
            columns = [pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())]
            if bytes_col:
                columns.append(decoded(found, token))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of every id; null for an id that the vocabulary skips."""
    token: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for t, i in ranks.items():
        token[i] = t
    return pa.array(token, pa.large_binary())


def decoded(packed: list[bytes | None], token: pa.Array) -> pa.Array:
    """The bytes that each row's ids stand for; an id outside the vocabulary is an error."""
    ids = np.frombuffer(b"".join(x or b"" for x in packed), "<u4")
    taken = token.take(pa.array(ids.astype(np.int64)))
    if taken.null_count:
        raise IndexError("an id is outside the vocabulary")
    rows = np.cumsum([0, *(len(x or b"") // 4 for x in packed)])
    ends = np.frombuffer(taken.buffers()[1], "<i8")[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    offsets = pa.py_buffer(ends[rows].astype("<i8"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(packed), [None, offsets, taken.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that packed token ids stand for; null ids give no bytes, an id beyond the vocabulary is an error."""
    ranks = df.sparkSession.sparkContext.broadcast(small_ranks(ranks_path))
    schema, kept = added(df, StructField(bytes_col, BinaryType()))

    def run(batches):
        token = token_bytes(ranks.value)
        for batch in (part for whole in batches for part in slices(whole, ids_col)):
            found = decoded(batch.column(ids_col).to_pylist(), token)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], names=schema.names)

    return df.mapInArrow(run, schema)
