"""Minimal perfect hashing of distinct numbers: n keys get the indices 0 to n - 1, without storing the keys.

Keys go through levels of bit arrays. On a level, a key that is alone in its slot sets the slot's bit; keys that meet go on
to the next level. A key's index is the number of bits set before its own. About four bits per key; all steps are array
operations. A number outside the set gets an index as well, so whoever looks up keeps the keys by index and compares.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from .words import U64, mix, random_numbers

SLOTS_PER_KEY = 2.0
SEEDS = random_numbers(1117, 256)


def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys ^ SEEDS[level % len(SEEDS)] + U64(level)) % U64(size)


class PerfectHash(NamedTuple):
    """Bits of all levels in one array of words, the bits set before each word, and the slots of each level."""

    words: np.ndarray
    before: np.ndarray
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, words: np.ndarray, sizes: tuple[int, ...]) -> PerfectHash:
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(words, np.cumsum(ones) - ones, sizes)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct 64-bit keys; a key that stands twice is an error."""
        left, words, sizes = keys.astype(U64), [np.zeros(0, U64)], []
        while len(left):
            if len(sizes) >= 4 * len(SEEDS):
                raise ValueError("the keys aren't distinct")
            size = max(64, int(SLOTS_PER_KEY * len(left) / 64 + 1) * 64)
            at = slot(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view("<u8").astype(U64))
            sizes.append(size)
            left = left[~alone]
        return cls.of(np.concatenate(words), tuple(sizes))

    def __len__(self) -> int:
        return int(np.bitwise_count(self.words).sum())

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Indices of keys; -1 for a number that no level takes."""
        keys = keys.astype(U64)
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = slot(keys[todo], level, size) + U64(base)
            place, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            word = self.words[place]
            hit = (word >> bit) & U64(1) == 1
            inside = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1))).astype(np.int64)
            out[todo[hit]] = self.before[place[hit]] + inside
            todo, base = todo[~hit], base + size
        return out

    def verified(self, keys: np.ndarray, by_index: np.ndarray) -> np.ndarray:
        """Indices of keys, -1 for every number that isn't the key kept at its index."""
        if not len(by_index):
            return np.full(len(keys), -1, np.int64)
        at = self.index(keys)
        return np.where((at >= 0) & (by_index[at] == keys), at, -1)

    def pack(self) -> bytes:
        return struct.pack(f"<q{len(self.sizes)}q", len(self.sizes), *self.sizes) + self.words.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, packed: bytes) -> PerfectHash:
        (levels,) = struct.unpack_from("<q", packed)
        sizes = struct.unpack_from(f"<{levels}q", packed, 8)
        return cls.of(np.frombuffer(packed, "<u8", offset=8 + 8 * levels).astype(U64), sizes)
