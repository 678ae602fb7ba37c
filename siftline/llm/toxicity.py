"""Toxic spans by a linear-chain conditional random field with two tags, toxic and other.

Training documents carry one label each. A feature of words (the word, its beginnings and its end) that stands in far more
toxic than clean documents, by a likelihood ratio beyond what chance gives among all features, labels the words of toxic
documents that have it; these labelled tokens train the field. Sequences are runs of 32 words of a document, in training and in
scoring, so forward-backward runs over all sequences of a batch at once, and a text of any length is scored whole. The
marginals of a document's words give its score and the offsets of its offending words.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from siftline.session import materialize

from .words import INVERSE, ODD, U64, Piece, column_of, letter_values, mix, pieces, powers, slices

RUN = 32
PREFIXES = (4, 5, 6, 7, 8, 10)
SUFFIX = 4
FEATURES = len(PREFIXES) + 2
FILTER_BITS = 22
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the first Latin block in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return low


def word_features(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its features as 64-bit numbers (0 where it is too short for one), and where it begins and ends without the punctuation around it."""
    data = lower_bytes(piece.data)
    start, end = piece.starts.copy(), piece.ends.copy()
    for _ in range(6):
        end -= (end > start + 1) & PUNCTUATION[data[end - 1]]
        start += (end > start + 1) & PUNCTUATION[data[start]]
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(letter_values(6, False)[data] * powers(ODD, n), out=sums[1:])
    shift = powers(INVERSE, n)
    length = end - start
    out = np.zeros((FEATURES, len(start)), U64)
    for i, size in enumerate(PREFIXES):
        long = length > size
        s = start[long]
        out[i, long] = mix((sums[s + size] - sums[s]) * shift[s] + U64(size)) | U64(1)
    long = length > SUFFIX
    e = end[long]
    out[-2, long] = mix((sums[e] - sums[e - SUFFIX]) * shift[e - SUFFIX] + U64(100)) | U64(1)
    out[-1] = mix((sums[end] - sums[start]) * shift[start] + U64(200) + length.astype(U64)) | U64(1)
    return out, start, end


def run_places(piece: Piece) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of every word in the table of runs, and the number of runs; a run never crosses documents."""
    counts = piece.counts()
    inside = np.arange(piece.doc_word[-1]) - np.repeat(piece.doc_word[:-1], counts)
    runs = -(-counts // RUN)
    first = np.cumsum(runs) - runs
    return np.repeat(first, counts) + inside // RUN, inside % RUN, int(runs.sum())


def marginals(
    emit: np.ndarray, there: np.ndarray, move: np.ndarray, begin: np.ndarray, weigh: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over runs: the probability of the toxic tag per place, and the expected moves between tags
    of runs that ``weigh`` so much.

    ``emit`` (runs, RUN) is the toxic tag's score, the other tag's is 0; ``there`` says which places hold a word.
    """
    n = len(emit)
    scores = np.zeros((RUN, n, 2))
    scores[:, :, 1] = np.where(there, emit, 0.0).T
    scores = np.exp(np.clip(scores, -30, 30))
    step, ahead = np.exp(move), np.zeros((RUN, n, 2))
    ahead[0] = np.exp(begin) * scores[0]
    ahead[0] /= ahead[0].sum(1, keepdims=True)
    for t in range(1, RUN):
        ahead[t] = (ahead[t - 1] @ step) * scores[t]
        ahead[t] /= ahead[t].sum(1, keepdims=True)
        gone = ~there[:, t]
        ahead[t, gone] = ahead[t - 1, gone]
    back = np.ones((n, 2))
    chance, moves = np.zeros((n, RUN)), np.zeros((2, 2))
    for t in range(RUN - 1, -1, -1):
        both = ahead[t] * back
        both /= both.sum(1, keepdims=True)
        chance[:, t] = np.where(there[:, t], both[:, 1], 0.0)
        if t:
            on = there[:, t]
            pair = ahead[t - 1][on][:, :, None] * step * (scores[t][on] * back[on])[:, None, :]
            if weigh is not None:
                moves += (pair * (weigh[on] / pair.sum(axis=(1, 2)))[:, None, None]).sum(0)
            fresh = (scores[t] * back) @ step.T
            back = np.where(on[:, None], fresh / fresh.sum(1, keepdims=True), back)
    return chance, moves


@dataclass(frozen=True)
class Field:
    """Feature numbers, ascending, with their weights; a bit filter over them; the scores of moves and of the first tag.

    ``raw`` and ``chance`` are points of the line that turns a document's noisy-or of marginals into the chance of its label.
    """

    features: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    raw: tuple = (0.0, 1.0)
    chance: tuple = (0.0, 1.0)

    @staticmethod
    def of(features: np.ndarray, weights: np.ndarray, move: np.ndarray, begin: np.ndarray) -> Field:
        order = np.argsort(features)
        known = np.zeros(1 << FILTER_BITS, bool)
        known[features >> U64(64 - FILTER_BITS)] = True
        return Field(features[order], weights[order], known, move, begin)

    def emissions(self, words: np.ndarray) -> np.ndarray:
        """The toxic tag's score of every word."""
        total = np.zeros(words.shape[1])
        for row in words:
            maybe = np.flatnonzero(self.known[row >> U64(64 - FILTER_BITS)])
            if len(maybe) and len(self.features):
                at = np.minimum(np.searchsorted(self.features, row[maybe]), len(self.features) - 1)
                total[maybe] += np.where(self.features[at] == row[maybe], self.weights[at], 0.0)
        return total


def sampled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows: the first by a hash of their id."""
    rank = F.xxhash64("doc_id")
    chosen = [
        labels.where(F.col("toxic") == flag).select("doc_id", F.col("toxic").cast("bigint").alias("toxic")).orderBy(rank, "doc_id").limit(most)
        for flag, most in ((1, most_toxic), (0, most_clean))
    ]
    both = chosen[0].union(chosen[1])
    return docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("text", "toxic")


def telling_features(sample: DataFrame) -> np.ndarray:
    """Features that stand in more toxic documents than chance explains, ascending."""

    def count(batches):
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            for piece in pieces(batch["text"]):
                words, _, _ = word_features(piece)
                doc = np.repeat(np.arange(piece.docs), piece.counts())
                key = np.tile(doc, FEATURES)
                flat = words.reshape(-1)
                order = np.lexsort((key, flat))
                flat, key = flat[order], key[order]
                fresh = np.ones(len(flat), bool)
                fresh[1:] = (flat[1:] != flat[:-1]) | (key[1:] != key[:-1])
                fresh &= flat != 0
                flat, flag = flat[fresh], toxic[piece.first + key[fresh]]
                distinct, back = np.unique(flat, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "feature": distinct.view(np.int64), "t": np.bincount(back, flag, len(distinct)).astype(np.int64),
                    "n": np.bincount(back, minlength=len(distinct)).astype(np.int64),
                })

    counts = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not counts["t"] or counts["t"] == counts["n"]:
        return np.zeros(0, U64)
    share = counts["t"] / counts["n"]
    found = materialize(
        sample.mapInArrow(count, "feature bigint, t bigint, n bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("n >= 3"),
        "features",
    )
    t, n = F.col("t"), F.col("n")
    ratio = t * F.ln(t / (n * share)) + F.when(n > t, (n - t) * F.ln((n - t) / (n * (1 - share)))).otherwise(0.0)
    bound = float(np.log(max(found.count(), 1)) + 1)
    telling = found.where((t >= 3) & (t * (1 - share) > 3 * (n - t) * share) & (ratio > bound)).orderBy(ratio.desc(), "feature").limit(20_000)
    return np.sort(np.array([r["feature"] for r in telling.select("feature").collect()], np.int64).view(U64))


def training_runs(sample: DataFrame, telling: np.ndarray, most_runs: int):
    """Features (FEATURES, words), tags and weight of a bounded number of runs, the first by a hash.

    A third each: with a tagged word, with a telling feature in a clean document, and without either;
    a run weighs as much as the runs of its kind that it stands for.
    """

    def runs(batches):
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            for piece in pieces(batch["text"]):
                words, _, _ = word_features(piece)
                row, _, n = run_places(piece)
                if not n:
                    continue
                at = np.minimum(np.searchsorted(telling, words), max(len(telling) - 1, 0))
                hit = (telling[at] == words).any(0) if len(telling) else np.zeros(words.shape[1], bool)
                near = hit.copy()
                hit &= np.repeat(toxic[piece.first : piece.first + piece.docs], piece.counts())
                edges = np.searchsorted(row, np.arange(n + 1))
                for i in range(n):
                    a, b = edges[i], edges[i + 1]
                    part = np.ascontiguousarray(words[:, a:b])
                    yield pa.RecordBatch.from_pydict({
                        "kind": [2 if hit[a:b].any() else int(near[a:b].any())], "h": [int(mix(part[-1] + U64(b - a)).sum().view(np.int64))],
                        "words": [part.tobytes()], "tags": [hit[a:b].tobytes()],
                    })

    found = sample.mapInArrow(runs, "kind bigint, h bigint, words binary, tags binary")
    found, chosen = materialize(found, "runs"), []
    there = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    for kind, n in sorted(there.items()):
        rows = found.where(F.col("kind") == kind).orderBy("h", "words").limit(most_runs // 3).select("words", "tags").collect()
        chosen += [(np.frombuffer(r["words"], U64).reshape(FEATURES, -1), np.frombuffer(r["tags"], bool), n / len(rows)) for r in rows]
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 9000, most_runs: int = 9000, rounds: int = 60,
) -> Field:
    """Train the field on a bounded sample of labelled documents.

    ``most_toxic`` and ``most_clean`` bound the documents, ``most_runs`` the runs of words whose features reach the driver
    (about 2 KB each). ``labels`` holds doc_id and toxic (1, 0, or null for none); ids without a document, and null ids, play no
    part. Without toxic or without clean rows the field gives every word the same small chance.
    """
    sample = materialize(sampled(docs, labels, most_toxic, most_clean), "labelled")
    telling = telling_features(sample)
    runs = training_runs(sample, telling, most_runs)
    start = Field.of(np.zeros(0, U64), np.zeros(0), np.array([[4.0, -4.0], [1.0, 0.0]]), np.array([4.0, -4.0]))
    if not runs or not len(telling):
        return start
    there = np.zeros((len(runs), RUN), bool)
    tags = np.zeros((len(runs), RUN))
    weigh = np.array([w for _, _, w in runs])
    for i, (_, tag, _) in enumerate(runs):
        there[i, : len(tag)] = True
        tags[i, : len(tag)] = tag
    place = np.flatnonzero(there.reshape(-1))
    words = np.concatenate([w for w, _, _ in runs], axis=1)
    features, column = np.unique(words, return_inverse=True)
    column = column.reshape(words.shape)
    usual = np.bincount(column.reshape(-1), minlength=len(features)) >= 3
    usual[features == 0] = False
    weight, move, begin = np.zeros(len(features)), start.move.copy(), start.begin.copy()
    flags = tags.astype(int)
    seen = np.zeros((2, 2))
    on = there[:, 1:]
    np.add.at(seen, (flags[:, :-1][on], flags[:, 1:][on]), np.broadcast_to(weigh[:, None], on.shape)[on])
    first = np.array([(weigh * (1 - tags[:, 0])).sum(), (weigh * tags[:, 0]).sum()])
    slots = [np.zeros_like(x) for x in (weight, move, begin)]
    for _ in range(rounds):
        emit = np.zeros(there.size)
        emit[place] = weight[column].sum(0)
        chance, moves = marginals(emit.reshape(there.shape), there, move, begin, weigh)
        error = ((tags - chance) * weigh[:, None]).reshape(-1)[place]
        steps = (
            (np.bincount(column.reshape(-1), np.tile(error, FEATURES), len(features)) - 0.05 * weight) * usual,
            seen - moves - 0.05 * move,
            first - np.array([(weigh * (1 - chance[:, 0])).sum(), (weigh * chance[:, 0]).sum()]) - 0.05 * begin,
        )
        for value, slot, step in zip((weight, move, begin), slots, steps):
            slot += step * step
            value += 0.5 * step / np.sqrt(slot + 1e-8)
    keep = usual & (np.abs(weight) > 0.02)
    field = Field.of(features[keep], weight[keep], move, begin)
    return calibrated(field, sample, labels)


def calibrated(field: Field, sample: DataFrame, labels: DataFrame) -> Field:
    """The field with a rising line from raw scores to the share of toxic documents, by pooling neighbouring bins.

    The sample's classes count by their shares among all labelled rows.
    """
    rows = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    bins = score(sample, field).groupBy(F.ceil(F.col("score") * 40).alias("bin"), "toxic").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("at")
    ).collect()
    taken = {flag: sum(r["n"] for r in bins if r["toxic"] == flag) for flag in (0, 1)}
    pools: list[list[float]] = []
    for b in range(41):
        here = [(r["toxic"], r["n"] * rows[r["toxic"]] / taken[r["toxic"]], r["at"]) for r in bins if r["bin"] == b]
        if not here:
            continue
        n = sum(w for _, w, _ in here)
        pools.append([n, sum(w for flag, w, _ in here if flag), sum(w * at for _, w, at in here)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return replace(field, raw=tuple(at / n for n, _, at in pools), chance=tuple((t + 0.01) / (n + 0.02) for n, t, _ in pools))


def score(docs: DataFrame, field: Field, text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """Add ``score``, the chance of the label toxic, and ``spans``, the byte offsets (start, end) of offending words.

    Marginals below 0.05 count as none, so that long texts don't add up doubts. A null or empty text scores
    like one without doubtful words and has no spans. Columns
    of these names are replaced; rows are independent of each other.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("score", "spans")]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("spans", ArrayType(span))])
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for piece in pieces(column_of(batch, text_col)):
                chance, start, end = word_chances(piece, model.value)
                doc = np.repeat(np.arange(piece.docs), piece.counts())
                at = np.flatnonzero(chance >= 0.05)
                clean = np.bincount(doc[at], np.log1p(-np.minimum(chance[at], 1 - 1e-12)), piece.docs)
                scores[piece.first : piece.first + piece.docs] = np.interp(1 - np.exp(clean), model.value.raw, model.value.chance)
                for i in np.flatnonzero(chance >= span_at):
                    begin = piece.doc_byte[doc[i]]
                    spans[piece.first + doc[i]].append({"start": int(start[i] - begin), "end": int(end[i] - begin)})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(scores), pa.array(spans, kind)], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def word_chances(piece: Piece, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, start, end = word_features(piece)
    row, column, n = run_places(piece)
    emit, there = np.zeros((n, RUN)), np.zeros((n, RUN), bool)
    there[row, column] = True
    emit[row, column] = field.emissions(words)
    tense = np.flatnonzero(emit.max(axis=1, initial=-1e9) > -0.5) if n else np.zeros(0, int)
    chance = np.zeros((n, RUN))
    if len(tense):
        chance[tense], _ = marginals(emit[tense], there[tense], field.move, field.begin)
    return chance[row, column], start, end
