"""Public tokenizers inside Arrow batches: ids of whole texts and the bytes of every id.

Vocabulary files are read once, on the driver, and go to the workers as a broadcast of checked size.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from typing import Any

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

MAX_FILE_BYTES = 64 << 20
#: Longer texts go to the general library: the fast one recurses over runs of white space of a million characters.
FAST_CHARS = 200_000
#: The pattern of byte-level pre-tokens.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")

_KNOWN: dict[str, Any] = {}


def read_file(path: str) -> bytes:
    """A vocabulary file, refused beyond ``MAX_FILE_BYTES``, as it is sent to every worker."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes and can't be sent to every worker")
    with open(path, "rb") as file:
        return file.read()


def known(kind: type, content: bytes) -> Any:
    """The tokenizer of a file's content; a worker keeps the last few it has built."""
    key = f"{kind.__name__}-{hashlib.md5(content).hexdigest()}"
    if key not in _KNOWN:
        if len(_KNOWN) >= 4:
            _KNOWN.clear()
        _KNOWN[key] = kind(content)
    return _KNOWN[key]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def narrowest(size: int) -> str:
    """The number type that holds ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Vocabulary:
    """The bytes of every id, and their lengths, as arrays; made once."""

    token: list[bytes]

    @functools.cached_property
    def tokens(self) -> pa.Array:
        return pa.array(self.token, pa.large_binary())

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.token], np.int64)


class ByteLevel(Vocabulary):
    """A byte-level BPE of a tokenizer file; strings of special tokens are ordinary text."""

    def __init__(self, content: bytes):
        self.content = content
        made = json.loads(content)
        vocab, letters = made["model"]["vocab"], byte_letters()
        self.size = max(vocab.values(), default=-1) + 1
        for extra in made["added_tokens"]:
            self.size = max(self.size, extra["id"] + 1)
        self.token = [b""] * self.size
        for text, number in vocab.items():
            self.token[number] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()

    @functools.cached_property
    def general(self) -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        made = Tokenizer.from_str(self.content.decode())
        made.encode_special_tokens = True
        return made

    @functools.cached_property
    def fast(self) -> tiktoken.Encoding | None:
        """The same vocabulary for the faster library, where its ids are the order of merges and nothing changes the text before."""
        made = json.loads(self.content)
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if made["normalizer"] is not None or not plain or model.get("ignore_merges"):
            return None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {t: i for i, t in enumerate(self.token[: 256 + len(pairs)])}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(self._one(t), dtype=np.uint32) for t in texts]

    def _one(self, text: str):
        if self.fast is not None and len(text) <= FAST_CHARS:
            return self.fast.encode_to_numpy(text)
        return self.general.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces(Vocabulary):
    """A model of word pieces with U+2581 for a space and bytes as <0xHH>."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        self.token = []
        for piece in map(self.model.id_to_piece, range(self.size)):
            byte = BYTE_PIECE.fullmatch(piece)
            self.token.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.uint32) for x in self.model.encode(texts, num_threads=1)]


def tokenizer_of(path: str, content: bytes) -> Any:
    """The tokenizer of a file, by its ending: ``.model`` for word pieces, else a byte-level tokenizer file."""
    return known(Pieces if path.endswith(".model") else ByteLevel, content)
