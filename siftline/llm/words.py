"""Words, fingerprints of word sequences and packed numbers, for whole Arrow batches at once.

A word is a run of characters other than space and the control characters 9 to 13, on UTF-8 bytes. Everything here works
on one flat byte array per piece of a batch, so no Python loop runs over words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
IS_WORD = ~IS_SPACE


def random_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=U64)


def letter_values(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z have the values of a-z."""
    values = random_numbers(seed, 256)
    if lower:
        values[65:91] = values[97:123]
    return values


#: The base of all fingerprints and its inverse modulo 2**64; fingerprints differ by the values that the powers multiply.
ODD = int(random_numbers(1001, 1)[0]) | 5
INVERSE = pow(ODD, -1, 2**64)


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64; kept up to four million."""
    have = POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Piece(NamedTuple):
    """A run of documents of one batch: rows ``first`` to ``first + len(doc_word) - 2``."""

    first: int
    data: np.ndarray
    doc_byte: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc_word: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.doc_word) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_word)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty texts, and where each text begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dot in the name a field of a struct."""
    column, _, field = name.partition(".")
    return batch.column(column).field(field) if field else batch.column(column)


def slices(batch: pa.RecordBatch, name: str, size: int = 4 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the texts of each part take about ``size`` bytes: what a worker sends back stays small as well."""
    _, offsets = text_bytes(column_of(batch, name))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string array into pieces of about ``size`` bytes, whole documents each, and find their words."""
    data, offsets = text_bytes(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield split_words(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def split_words(first: int, data: np.ndarray, doc_byte: np.ndarray) -> Piece:
    word = IS_WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = doc_byte[(doc_byte > 0) & (doc_byte < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    return Piece(first, data, doc_byte, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, doc_byte))


def word_values(piece: Piece, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of every word."""
    if not len(piece.starts):
        return np.zeros(0, U64)
    n = len(piece.data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(letter_values(seed, lower)[piece.data] * powers(ODD, n), out=sums[1:])
    return mix((sums[piece.ends] - sums[piece.starts]) * powers(INVERSE, n)[piece.starts] + (piece.ends - piece.starts).astype(U64))


def window_values(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of every run of ``length`` values; runs across documents are left to the caller."""
    n = len(values)
    if n < length:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * powers(ODD, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(INVERSE, n)[: n - length + 1])


def window_starts(piece: Piece, length: int) -> np.ndarray:
    """Positions of the words of a piece that begin ``length`` words of one document."""
    counts = piece.counts()
    left = np.repeat(piece.doc_word[1:], counts) - np.arange(piece.doc_word[-1])
    return np.flatnonzero(left >= length)


def doc_of_words(piece: Piece) -> np.ndarray:
    return np.repeat(np.arange(piece.docs), piece.counts())


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, lowest first; every plane but the lowest is compressed, and empty ones are left out."""
    numbers = np.ascontiguousarray(numbers, U64)
    planes = numbers.view(np.uint8).reshape(-1, 8)
    used = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    parts = [np.ascontiguousarray(planes[:, i]).tobytes() for i in range(used)]
    parts = [squeeze(p) for p in parts]
    head = np.array([len(numbers), used, *map(len, parts)], np.int64).tobytes()
    return head + b"".join(parts)


def squeeze(part: bytes) -> bytes:
    """Compressed when its first bytes suggest that this saves something."""
    head = part[:4096]
    if len(set(head)) > 200:
        return b"\0" + part
    return b"\1" + zlib.compress(part, 1)


def unpack(packed: bytes) -> np.ndarray:
    n, used = np.frombuffer(packed, np.int64, 2)
    sizes = np.frombuffer(packed, np.int64, int(used), 16)
    out = np.zeros((int(n), 8), np.uint8)
    at = 16 + 8 * int(used)
    for i, size in enumerate(sizes):
        part = packed[at : at + int(size)]
        out[:, i] = np.frombuffer(part[1:] if part[:1] == b"\0" else zlib.decompress(part[1:]), np.uint8)
        at += int(size)
    return out.view(U64).reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their differences."""
    steps = np.array(numbers, U64)
    steps[1:] -= numbers[:-1].astype(U64)
    return pack(steps)


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=U64)


def pack_flags(flags: np.ndarray) -> bytes:
    return np.array([len(flags)], np.int64).tobytes() + zlib.compress(np.packbits(flags).tobytes(), 1)


def unpack_flags(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    return np.unpackbits(np.frombuffer(zlib.decompress(packed[8:]), np.uint8), count=n).astype(bool)
