"""Documents with everything that operators must bear: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, chunk string, row string, n string, cls string, "
    "n_words string, kept string, quality string, votes string, score string, spans string, token_ids string, n_tokens string, decoded string, matches string, shard string, size string"
)
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))


def rows():
    texts = [
        (1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (3, None), (4, ""), (5, " \n\t "), (None, "a text without an id"),
        (None, None), (6, "ties ties ties ties ties ties"), (7, LONG), (8, LONG + " end"), (9, "x" * 200_000), (1, "one two three four five six seven eight"),
        (10, "é日本 😀 \x00 <|endoftext|>"), (11, "three words only"), (12, "three words only"),
    ]
    return [(i, t, None if i == 4 else "en", None if i == 3 else "s", None, *["x"] * 17) for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
