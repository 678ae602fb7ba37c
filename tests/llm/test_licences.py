import random
import re
import textwrap

import pytest

from siftline.llm import licences
from siftline.llm.licences import ORDINARY, OTHERS, TEMPLATES, fit, grams, hints, plain_grams, scan, varied

from . import edge

SF = "/root/testdata/sf0.1"
# The notices in the given documents.
NOTICES = {
    "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_given_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in scan(docs, model).join(docs, "doc_id").select("families", "text", "family").collect():
        want = sorted(f for f, notice in NOTICES.items() if notice in r.text)
        assert list(r.families) == want and (r.family in want or (not want and r.family in ("none", "unknown")))


def test_unseen_variants(spark, model):
    chance = random.Random(99)
    rows = [(f, s) for f, ts in TEMPLATES.items() for t in ts for s in varied(t, chance, ["dolor", "sit", "amet"], 6)]
    docs = spark.createDataFrame([(i, s, f) for i, (f, s) in enumerate(rows)], "doc_id bigint, text string, want string")
    found = {r.doc_id: r.family for r in scan(docs, model).collect()}
    right = sum(found[i] == f for i, (f, _) in enumerate(rows))
    named = sum(found[i] not in ("none", "unknown") for i in range(len(rows)))
    wrong = sum(found[i] not in (f, "none", "unknown") for i, (f, _) in enumerate(rows))
    assert right >= 0.75 * len(rows) and wrong <= 0.04 * max(named, 1)


def test_other_licences_and_ordinary_sentences(spark, model):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([*OTHERS, *ORDINARY])], "doc_id bigint, text string")
    found = {r.doc_id: r for r in scan(docs, model).collect()}
    assert sum(found[i].confirmed for i in range(len(OTHERS))) <= 1
    assert all(found[i].family == "none" for i in range(len(OTHERS), len(OTHERS) + len(ORDINARY)))


def test_grams_are_the_same_in_both_places(spark):
    rows = [("Licensed under the Apache License, Version 2.0.",), ("a",), ("",), ("--- . x.y -z- CC BY-NC 4.0!",), ("É ß a",)]
    for r in spark.createDataFrame(rows, "s string").select("s", grams(licences.F.col("s")).alias("g")).collect():
        assert sorted(r.g) == plain_grams(r.s)


def test_hints_lose_no_licence(spark, model):
    """Random sentences of the model's own words: whoever reaches even odds matches the pattern."""
    words = sorted({w for g in model.weights for w in g.split(" ")})
    rng = random.Random(1)
    pattern = re.compile(hints(model))
    for _ in range(3000):
        s = " ".join(rng.choices(words, k=rng.randrange(1, 14)))
        if 1 - model.chances(s)[0] >= 0.5:
            assert pattern.search(s), s


def test_edges(spark, model):
    docs = edge.documents(spark)
    out = scan(docs, model)
    assert out.count() == docs.count() and all(r.family in ("none", "unknown") for r in out.collect())
    assert scan(edge.empty(spark), model).count() == 0
    assert fit(edge.empty(spark)).classes == model.classes
    long = spark.createDataFrame([(1, "word " * 200_000 + "\n" + NOTICES["MIT"] + " Tail"), (1, NOTICES["GPL"]), (None, NOTICES["MIT"])], "doc_id bigint, text string")
    assert sorted((r.family for r in scan(long, model).collect())) == ["GPL", "MIT", "MIT"]


# Usual headers of source files.
HEADERS = {
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
}


def test_wrapped_headers(spark, model):
    """A notice counts once and with its own family at every width, in comment signs, and inside a long run of lines without a full stop."""
    rows = []
    for family, header in HEADERS.items():
        for width in (40, 60, 72, 80):
            for sign in ("", "# ", " * ", "// "):
                lines = textwrap.wrap(header, width)
                block = "\n".join(sign + x for x in ["Copyright (c) 2020 Some Body", "", *lines])
                rows.append((family, block))
                rows.append((family, "int x\n" * 40 + block + "\n" + "int y\n" * 40))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in scan(docs, model).collect()}
    bad = [(f, t, found[i]) for i, (f, t) in enumerate(rows) if list(found[i].families) != [f] or found[i].family != f]
    assert not bad, (len(bad), len(rows), bad[:3])


def test_lines_without_full_stop(spark, model):
    """Notices on lines of their own keep their families when no full stop stands between them."""
    text = "Released under the MIT License\nLicensed under CC BY-NC 4.0\nLicensed under the Apache License, Version 2.0\n\n" + "\n".join(textwrap.wrap(HEADERS["BSD"], 60))
    row = scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).collect()[0]
    assert list(row.families) == ["Apache-2.0", "BSD", "CC-BY-NC", "MIT"]
