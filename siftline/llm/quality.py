"""Quality by weak supervision: rules vote good or bad or abstain, and expectation-maximisation weighs the votes.

A rule never rejects a document by itself. The votes of all documents are counted by pattern, of which there are at most 3 to
the number of rules; on these counts EM estimates how often each rule votes what on good and on bad documents, and with these
rates every pattern gets a posterior probability of good quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siftline.session import small_table

from .words import INVERSE, IS_WORD, ODD, U64, column_of, letter_values, mix, pieces, powers, slices, window_starts, window_values, word_values

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper", "n_calls",
    "n_clean",
)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
CALL = np.zeros(256, bool)
CALL[ord("!")] = True
MARK = ~LETTER & (np.arange(256) < 128)
STOP = np.zeros(256, bool)
STOP[list(b".,;:?!")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring edges."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[edges])


def firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it stands more than once, and whether this is one of its later places."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    like_last = np.zeros(len(v), bool)
    like_last[1:] = v[1:] == v[:-1]
    like_next = np.zeros(len(v), bool)
    like_next[:-1] = like_last[1:]
    several, later = np.empty(len(v), bool), np.empty(len(v), bool)
    several[order], later[order] = like_last | like_next, like_last
    return several, later


def piece_stats(piece) -> dict[str, np.ndarray]:
    doc_key = mix(np.arange(piece.docs, dtype=U64) + U64(1))
    word_doc = np.repeat(np.arange(piece.docs), piece.counts())
    values = word_values(piece, 4)
    starts = window_starts(piece, 3)
    several, _ = firsts(window_values(values, 3)[starts] ^ doc_key[word_doc[starts]])
    cover = np.zeros(len(values) + 3, bool)
    for i in range(3):
        cover[starts[several] + i] = True
    _, known = firsts(values ^ doc_key[word_doc])
    line_start, line_end, line_doc = lines(piece)
    n = len(piece.data)
    sums, in_words = np.zeros(n + 1, U64), np.zeros(n + 1, np.int64)
    np.cumsum(letter_values(5, False)[piece.data] * powers(ODD, n), out=sums[1:])
    word_bytes = IS_WORD[piece.data]
    np.cumsum(word_bytes, out=in_words[1:])
    hold = in_words[line_end] > in_words[line_start]
    line_start, line_end, line_doc = line_start[hold], line_end[hold], line_doc[hold]
    line_value = (sums[line_end] - sums[line_start]) * powers(INVERSE, n + 1)[line_start] + (line_end - line_start).astype(U64)
    _, repeat = firsts(mix(line_value) ^ doc_key[line_doc])
    marks = np.zeros(n + 1, np.int64)
    np.cumsum(MARK[piece.data], out=marks[1:])
    marks = marks[piece.ends] - marks[piece.starts]
    clean = (marks == 0) | ((marks == 1) & STOP[piece.data[piece.ends - 1]])
    return {
        "n_words": piece.counts(),
        "word_chars": per_doc(word_bytes & LEAD[piece.data], piece.doc_byte),
        "n_symbols": per_doc(SYMBOL[piece.data], piece.doc_byte),
        "n_dup_lines": np.bincount(line_doc[repeat], minlength=piece.docs),
        "n_repeat_words": per_doc(cover[: len(values)], piece.doc_word),
        "n_lines": np.bincount(line_doc, minlength=piece.docs),
        "n_distinct": per_doc(~known, piece.doc_word),
        "n_letters": per_doc(LETTER[piece.data], piece.doc_byte),
        "n_upper": per_doc(UPPER[piece.data], piece.doc_byte),
        "n_calls": per_doc(CALL[piece.data], piece.doc_byte),
        "n_clean": per_doc(clean, piece.doc_word),
    }


def lines(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lines of all documents begin and end, and whose they are."""
    breaks = np.flatnonzero(piece.data == 10)
    start = np.unique(np.concatenate([piece.doc_byte[:-1], breaks + 1]))
    start = start[start < len(piece.data)]
    doc = np.searchsorted(piece.doc_byte, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(piece.data)), piece.doc_byte[doc + 1])
    ends_in_break = piece.data[end - 1] == 10
    return start, np.where(ends_in_break, end - 1, end), doc


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts named in STATS to every row; columns of these names are replaced. A null text has only zeros."""
    kept = [f for f in docs.schema.fields if f.name not in STATS]
    schema = StructType([*kept, *[StructField(name, LongType()) for name in STATS]])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            parts = [piece_stats(p) for p in pieces(column_of(batch, text_col))]
            columns = [np.concatenate([p[name] for p in parts] or [np.zeros(0)]).astype(np.int64) for name in STATS]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *map(pa.array, columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, "b").when(good, "g").otherwise("a")


def votes() -> Column:
    """One letter per rule: g good, b bad, a abstain. A rule abstains where its measure says little."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / words
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    return F.concat(
        vote(share("n_symbols") > 0.2, F.lit(False)),
        vote(share("n_clean") < 0.7, share("n_clean") > 0.9),
        vote(share("n_repeat_words") > 0.4, share("n_repeat_words") < 0.15),
        vote((F.col("n_lines") >= 4) & (F.col("n_dup_lines") > 0.4 * F.col("n_lines")), F.lit(False)),
        vote(F.col("n_upper") > 0.4 * letters, F.lit(False)),
        vote(share("n_calls") > 0.25, F.lit(False)),
        vote((F.col("n_words") >= 20) & (F.col("n_distinct") < 2.5 * F.sqrt(words)), F.col("n_distinct") > 4 * F.sqrt(words)),
        vote(~F.col("word_chars").between(2 * words, 16 * words), F.lit(False)),
        vote(F.col("n_words") < 5, F.lit(False)),
    )


@dataclass(frozen=True)
class VoteModel:
    """The posterior of every pattern of votes, the share of good documents, and each rule's rate of g, b and a per class."""

    posterior: dict[str, float]
    prior: float
    rates: tuple


def fit(stats: DataFrame, rounds: int = 200) -> VoteModel:
    """Estimate the rules' accuracies from all documents' votes.

    Only counts by pattern reach the driver, at most 3 to the number of rules. The first guess: the more bad votes, the worse. A
    prior of a twentieth of all documents, good ones without a bad vote, says that rules are seldom wrong about good text. Without documents the model is empty.
    """
    found = sorted(stats.groupBy(votes().alias("pattern")).count().collect())
    if not found:
        return VoteModel({}, 1.0, ())
    patterns, counts = [r["pattern"] for r in found], np.array([r["count"] for r in found], float)
    cells = np.array([[[c == x for x in "gba"] for c in p] for p in patterns], float)
    good = 0.9 * 0.1 ** cells[:, :, 1].sum(1)
    belief = cells[:, :, [0, 2]].mean(axis=(0, 1)) * counts.sum() / 20
    belief = np.array([[belief[0], 0.0, belief[1]], [0.0, 0.0, 0.0]])
    for _ in range(rounds):
        rates = []
        for weight, known in zip((good, 1 - good), belief):
            seen = np.einsum("p,prx->rx", counts * weight, cells) + known + 1.0
            rates.append(seen / seen.sum(1, keepdims=True))
        prior = (counts * good).sum() / counts.sum()
        odds = np.log(prior + 1e-9) - np.log(1 - prior + 1e-9) + np.einsum("prx,rx->p", cells, np.log(rates[0]) - np.log(rates[1]))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(fresh - good).max() < 1e-9:
            break
        good = fresh
    return VoteModel(dict(zip(patterns, good.tolist())), float(prior), tuple(map(lambda r: r.tolist(), rates)))


def judge(stats: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (the posterior) and kept.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows of three words. ``kept``: not base_failed, and a posterior of
    at least ``threshold``. A pattern that the model has never met counts as good.
    """
    table = small_table(stats.sparkSession, sorted(model.posterior.items()), "votes string, quality double")
    judged = stats.drop("votes", "quality", "base_failed", "kept").withColumn("votes", votes()).join(F.broadcast(table), "votes", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("quality", F.coalesce("quality", F.lit(1.0))).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("quality") >= threshold)
    )


def quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows with their counts, quality and verdict; the rules' accuracies are estimated from the same rows.

    A null or empty text has no words and fails the base rules. Repeated rows count as often as they stand there and get the
    same verdict. Columns named like a result are replaced; an empty table gives an empty result.
    """
    stats = text_stats(docs, text_col)
    return judge(stats, fit(text_stats(docs.select(F.col(text_col).alias("text")))), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with the columns of ``docs``."""
    return quality(docs.select(F.struct("*").alias("row")), "row.text", threshold).where("kept").select("row.*")
