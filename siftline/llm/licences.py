"""Licence scans: a trained sentence classifier, a calibrated unknown class, and templates that confirm its predictions.

The model is a softmax regression over word one- and two-grams, fitted on notices of known families, varied by dropped, swapped
and added words, and on ordinary sentences of the corpus. It is small and goes into the plan as literals. Scanning uses column
expressions only: documents without any word that speaks for a licence can't reach a family and are passed over by one
pattern, which follows from the model; in the others every sentence is scored, and a family counts as confirmed when one of
its templates is found in the sentence. A sentence may be wrapped over several lines of a paragraph: then its lines and overlapping
windows of its words are scored, and what is only a part of a notice found more fully falls away.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual notices of licence families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License, Version 2.0.", "Released under the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL version 2.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 3.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 3.0.",
    ],
    "CC0": [
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "ISC": [
        "Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC license.",
    ],
}
# Notices of other licences, which must come out as unknown.
OTHERS = [
    "Licensed under the Eclipse Public License, version 2.0.", "Released under the zlib license.", "Licensed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, version 1.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the Do What The Fun You Want To Public License.", "Licensed under the Open Software License 3.0.",
    "This file is licensed under a commercial license agreement.", "Licensed under the Python Software Foundation License.",
]
# Sentences with words of licences that are none.
ORDINARY = [
    "He lost his driving license and the car was sold.", "Please read the terms of the sale before you sign.", "The public was free to use the park.",
    "This work is hard and the version of the story is old.", "A copy of the letter was found in the general office.", "They released the film in May under a new name.",
    "The source of the river is in the north.", "The conditions of use follow in the next chapter.", "Permission to enter the building was granted.",
]
STOPS = frozenset("a all an and any are as at be by can for from has in is it may met not of on or s that the this to was with you".split())
#: Paragraphs part at lines without letters and digits, sentences after a full stop before a capital; marks that start a line (comment signs) go.
PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"
SENTENCE = r"(?<=[.!?])(?:\s+|\s*\n[^\p{L}\p{N}]*)(?=\p{Lu})"
LINE = r"\n[^\p{L}\p{N}]*"
#: Words of a window over a wrapped sentence. Windows lie half a window apart, so one of them holds any notice of up to 33 words whole.
WINDOW = 64
NONE = "none"
UNKNOWN = "unknown"


def plain_grams(sentence: str) -> list[str]:
    words = [w for x in re.split(r"[^a-z0-9.+-]+", sentence.lower()) if (w := x.strip(".-"))]
    return sorted({*words, *map(" ".join, zip(words, words[1:]))})


def grams(sentence: Column) -> Column:
    """The distinct one- and two-grams of a sentence's words, in lower case."""
    words = F.filter(
        F.transform(F.split(F.lower(sentence), r"[^a-z0-9.+-]+"), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), lambda w: w != ""
    )
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often and in whatever lambda ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


@dataclass(frozen=True)
class Model:
    """Classes (the first is no licence), the weight of each gram per class, biases, and the least probability that names a family.

    ``common`` are words of the corpus's ordinary sentences.
    """

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    least: float
    common: frozenset[str] = frozenset()

    def logits(self, sentence: str) -> np.ndarray:
        return np.array(self.bias) + sum((np.array(self.weights[g]) for g in plain_grams(sentence) if g in self.weights), np.zeros(len(self.bias)))

    def chances(self, sentence: str) -> np.ndarray:
        x = self.logits(sentence)
        x = np.exp(x - x.max())
        return x / x.sum()


def varied(sentence: str, chance: random.Random, filler: list[str], n: int) -> list[str]:
    """The sentence and ``n`` variants with words dropped, added and cased otherwise."""
    out = [sentence]
    for _ in range(n):
        words = [w for w in sentence.split() if chance.random() > 0.08]
        for _ in range(chance.randrange(3)):
            words.insert(chance.choice((0, len(words))), chance.choice(filler))
        text = " ".join(words)
        out.append(chance.choice((text, text, text.upper(), text.lower())))
    return out


def corpus_sentences(docs: DataFrame, text_col: str, most_docs: int) -> list[str]:
    """Ordinary sentences: one per document, no longer than 300 characters, of the first documents by a hash of the sentence."""
    sentence = F.substring(F.element_at(F.split(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 2000), r"\n"), 1), 1, 300)
    found = docs.select(sentence.alias("s")).where("s <> ''").orderBy(F.xxhash64("s"), "s").limit(most_docs)
    return [r["s"] for r in found.collect()]


def fit(docs: DataFrame, text_col: str = "text", most_docs: int = 300, variants: int = 30, rounds: int = 150, seed: int = 7) -> Model:
    """Fit on varied notices, the fixed ordinary sentences and at most ``most_docs`` sentences of the corpus.

    A quarter of the variants and of the other licences' notices is held out to choose the temperature and the least probability.
    """
    chance = random.Random(seed)
    corpus = [s for s in corpus_sentences(docs, text_col, most_docs) if not re.search(r"(?i)licen[cs]|copyright|public domain|permission", s)]
    filler = sorted({w for s in corpus for w in s.split() if w.isalpha()})[:2000] or ["text"]
    classes = (NONE, *TEMPLATES)
    rows = [(s, 0) for o in ORDINARY for s in varied(o, chance, filler, 6)] + [(s, 0) for s in corpus]
    rows += [(s, i) for i, f in enumerate(TEMPLATES, 1) for t in TEMPLATES[f] for s in varied(t, chance, filler, variants)]
    chance.shuffle(rows)
    held, rows = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    counts: dict[str, int] = {}
    for s, _ in rows:
        for g in plain_grams(s):
            counts[g] = counts.get(g, 0) + 1
    notices = {g for t in (*sum(TEMPLATES.values(), []), *ORDINARY) for g in plain_grams(t)}
    names = sorted(g for g, n in counts.items() if n >= 4 and g in notices and not STOPS.issuperset(g.split(" ")))
    number = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (s, _) in enumerate(rows):
        x[i, [number[g] for g in plain_grams(s) if g in number]] = 1
    y = np.eye(len(classes))[[c for _, c in rows]]
    w, slot = np.zeros((x.shape[1], len(classes))), np.zeros((x.shape[1], len(classes)))
    w[-1, 0] = 4.0
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = x.T @ (y - p) - 0.02 * w
        slot += step * step
        w += 0.3 * step / np.sqrt(slot + 1e-9)
    keep = [g for g in names if np.abs(w[number[g]]).max() > 0.05]
    common = frozenset(x for s in (*corpus, *ORDINARY) for x in plain_grams(s) if " " not in x)
    raw = Model(classes, {g: tuple(w[number[g]]) for g in keep}, tuple(w[-1]), 0.0, common)
    return calibrated(raw, held, [s for o in OTHERS for s in varied(o, chance, filler, 6)])


def calibrated(raw: Model, held: list[tuple[str, int]], others: list[str]) -> Model:
    """Divide the weights by the temperature that fits the held-out rows best, then find the least probability.

    It is the one at which held-out notices and notices of other licences are told apart with the fewest mistakes.
    """
    logits, wanted = [raw.logits(s) for s, _ in held], [c for _, c in held]

    def loss(t: float) -> float:
        total = 0.0
        for x, c in zip(logits, wanted):
            z = x / t
            total += math.log(np.exp(z - z.max()).sum()) + z.max() - z[c]
        return total

    t = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    scaled = Model(raw.classes, {g: tuple(round(v / t, 4) for v in w) for g, w in raw.weights.items()}, tuple(round(v / t, 4) for v in raw.bias), 0.0, raw.common)
    known = np.sort([scaled.chances(s)[1:].max() for s, c in held if c])
    other = np.sort([scaled.chances(s)[1:].max() for s in others])
    cuts = np.unique(np.round(np.concatenate([[0.5], known, other]), 4))
    mistakes = [(known < c).mean() + (other >= c).mean() for c in cuts]
    return Model(scaled.classes, scaled.weights, scaled.bias, float(np.clip(cuts[int(np.argmin(mistakes))], 0.5, 0.95)), raw.common)


def hints(model: Model) -> str:
    """A pattern that every sentence matches in which a licence is as likely as none.

    The words that ordinary sentences don't have are in it, and as many others as are needed: the grams without any word of the
    pattern, all taken together, must not outweigh the bias of no licence for any family.
    """
    margin = {g: np.maximum(np.array(w[1:]) - w[0], 0) for g, w in model.weights.items()}
    gap = model.bias[0] - np.array(model.bias[1:]) - math.log(len(model.bias) - 1)
    words = {x for g, m in margin.items() if m.max() > 0 for x in g.split(" ")} - model.common
    rest = {g: m for g, m in margin.items() if not words & set(g.split(" "))}
    while rest and (sum(rest.values()) >= gap).any():
        worst = max(rest, key=lambda g: (rest[g].max(), g))
        words.add(min(worst.split(" "), key=lambda x: (x in STOPS, -len(x))))
        rest = {g: m for g, m in rest.items() if not words & set(g.split(" "))}
    by_letter: dict[str, list[str]] = {}
    for x in sorted(words):
        by_letter.setdefault(x[0], []).append(re.escape(x[1:]))
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{re.escape(a)}(?:{'|'.join(ends)})" for a, ends in by_letter.items()) + r")(?![a-z0-9])"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.6) -> DataFrame:
    """One row per document: the id, family, probability, template_share, confirmed, n_sentences and families.

    ``family`` is that of the document's most probable licence notice: a known family, ``unknown`` when a licence is likely but no
    family reaches the least probability or no template confirms it, or ``none``. ``families`` has all confirmed families of
    the document in order, ``n_sentences`` counts its notices. ``template_share`` is the share of the best template's grams that the notice has;
    from ``similar`` on it confirms. A sentence on one line is scored as it is. Of one wrapped over several lines, the lines and
    windows of its words are scored; a line falls away where a window of the sentence has more of a template with all the grams that
    the line shares with its own, and a window where a line or another window does. A null or empty text has no notice.
    Rows are independent, so repeated rows get equal results; an empty table gives an empty result; other columns play no part.
    """
    k = len(model.classes)
    keys = F.array(*map(F.lit, model.weights)) if model.weights else F.array().cast("array<string>")
    table = F.map_from_arrays(keys, F.array(*[F.array(*map(F.lit, w)) for w in model.weights.values()]))
    templates = F.array(*[
        F.array(*[F.array(*map(F.lit, plain_grams(t))) for t in TEMPLATES.get(c, ["-"])]) for c in model.classes
    ])
    text = F.coalesce(F.col(text_col), F.lit(""))
    hint = hints(model)
    sentences = F.filter(F.flatten(F.transform(F.split(text, PARAGRAPH), lambda p: F.split(p, SENTENCE))), lambda s: s.rlike(hint))

    def pieces(sentence: Column) -> Column:
        """The lines of a sentence and, where it has more than one, windows of its words."""
        def windows(words: Column) -> Column:
            last = F.greatest(F.ceil((F.size(words) - WINDOW) / F.lit(WINDOW / 2)), F.lit(0)).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
                F.concat_ws(" ", F.slice(words, i * (WINDOW // 2) + 1, WINDOW)).alias("text"), F.lit(True).alias("wide")
            ))

        lines = F.transform(F.split(sentence, LINE), lambda s: F.struct(s.alias("text"), F.lit(False).alias("wide")))
        wide = bound(F.split(F.regexp_replace(sentence, LINE, " "), r"\s+"), windows)
        return F.filter(F.when(F.instr(sentence, "\n") > 0, F.concat(lines, wide)).otherwise(lines), lambda x: x["text"].rlike(hint))

    def scored(piece: Column) -> Column:
        have = grams(piece["text"])
        known = F.array_intersect(have, keys)
        logits = F.aggregate(
            known, F.array(*map(F.lit, model.bias)), lambda total, g: F.zip_with(total, F.element_at(table, g), lambda a, b: a + b)
        )
        return F.struct(piece["wide"].alias("wide"), have.alias("grams"), logits.alias("logits"))

    def judged(s: Column) -> Column:
        top = F.array_max(s["logits"])
        parts = F.transform(s["logits"], lambda x: F.exp(x - top))
        total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
        best = F.array_max(F.slice(s["logits"], 2, k - 1))
        number = F.array_position(F.slice(s["logits"], 2, k - 1), best).cast("int") + 1
        match = F.array_max(F.transform(
            F.element_at(templates, number),
            lambda t: F.struct((F.size(F.array_intersect(t, s["grams"])) / F.size(t).cast("double")).alias("share"), t.alias("template")),
        ))
        return F.struct(
            s["wide"].alias("wide"), s["grams"].alias("grams"), (F.exp(best - top) / total).alias("probability"), match.alias("match"),
            F.element_at(F.array(*map(F.lit, model.classes)), number).alias("family"),
            (1 - F.element_at(parts, 1) / total).alias("licence"),
        )

    def named(s: Column) -> Column:
        share = s["match"]["share"]
        confirmed = (s["probability"] >= model.least) & (share >= similar)
        return F.struct(
            s["wide"].alias("wide"), s["licence"].alias("licence"), F.when(confirmed, s["family"]).otherwise(F.lit(UNKNOWN)).alias("family"),
            s["probability"].alias("probability"), share.alias("template_share"), confirmed.alias("confirmed"),
            s["match"]["template"].alias("template"), F.array_intersect(s["match"]["template"], s["grams"]).alias("shared"),
        )

    def apart(found: Column) -> Column:
        """The pieces of a sentence without those that are part of a notice which another piece has more of."""

        def marks(wide: bool) -> Column:
            some = F.filter(found, lambda s: s["wide"] == F.lit(wide))
            return F.array_distinct(F.transform(some, lambda s: F.struct(F.struct(s["confirmed"], s["template_share"]).alias("rank"), s["template"].alias("template"))))

        def part(s: Column, mark: Column) -> Column:
            return F.size(F.array_except(s["shared"], mark["template"])) == 0

        def rank(s: Column) -> Column:
            return F.struct(s["confirmed"], s["template_share"])

        def kept(both: Column) -> Column:
            lines = F.filter(found, lambda s: ~s["wide"] & ~F.exists(both["wide"], lambda m: (m["rank"] > rank(s)) & part(s, m)))
            wide = F.filter(found, lambda s: s["wide"] & ~F.exists(both["lines"], lambda m: (m["rank"] >= rank(s)) & part(s, m)) & ~F.exists(
                both["wide"], lambda m: (m["rank"] > rank(s)) & part(s, m)
            ))
            return F.concat(F.transform(lines, small), bound(wide, once))

        def once(wide: Column) -> Column:
            return F.transform(F.array_distinct(F.transform(wide, lambda s: s["template"])), lambda t: F.array_max(
                F.transform(F.filter(wide, lambda s: s["template"] == t), small)
            ))

        return bound(F.struct(marks(False).alias("lines"), marks(True).alias("wide")), kept)

    def small(s: Column) -> Column:
        return F.struct(*[s[x].alias(x) for x in ("confirmed", "probability", "family", "template_share")])

    def notices(sentence: Column) -> Column:
        found = F.filter(F.transform(F.transform(F.transform(pieces(sentence), scored), judged), named), lambda s: s["licence"] >= 0.5)
        return bound(found, lambda x: F.when(F.exists(x, lambda s: s["wide"]), apart(x)).otherwise(F.transform(x, small)))

    kind = "array<struct<confirmed:boolean,probability:double,family:string,template_share:double>>"
    rows = docs.select(F.col(id_col), F.when(text.rlike(hint), F.flatten(F.transform(sentences, notices))).otherwise(F.array().cast(kind)).alias("found__"))
    return rows.withColumn("best__", F.array_max("found__")).select(
        id_col, F.coalesce(F.col("best__")["family"], F.lit(NONE)).alias("family"),
        F.coalesce(F.col("best__")["probability"], F.lit(0.0)).alias("probability"),
        F.coalesce(F.col("best__")["template_share"], F.lit(0.0)).alias("template_share"),
        F.coalesce(F.col("best__")["confirmed"], F.lit(False)).alias("confirmed"), F.size("found__").cast("bigint").alias("n_sentences"),
        F.array_sort(F.array_distinct(F.transform(F.filter("found__", lambda s: s["confirmed"]), lambda s: s["family"]))).alias("families"),
    )
