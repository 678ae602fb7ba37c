import functools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftline.llm.packing import Queues, pack, padded_length, serve

from . import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")
SAMPLE = "/root/testdata/sf0.001/documents.parquet"


PEER = Tokenizer.from_file(PATH)
PEER.encode_special_tokens = True


@functools.cache
def ids_of(text):
    return [*PEER.encode(text or "", add_special_tokens=False).ids, 1]


def checked(docs, rows, length, **how):
    """Every id in exactly one piece, windows full and without gaps; returns tokens by window and source."""
    pieces = pack(docs, PATH, length=length, **how).collect()
    want = sorted(tuple(ids_of(t)) for _, t in rows)
    docs_of, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.token_ids) == 4 * p.length and p.length > 0
        docs_of[p.doc_id, p.doc_tokens].append((p.start, tuple(np.frombuffer(p.token_ids, "<u4").tolist())))
        windows[p.sequence_id].append(p)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i, len(ids_of(t))].append(tuple(ids_of(t)))
    assert sum(map(len, texts.values())) == len(want)
    assert {k: sum(len(x) for _, x in v) for k, v in docs_of.items()} == {k: sum(map(len, v)) for k, v in texts.items()}
    for key, found in docs_of.items():
        if len(texts[key]) == 1:
            at = 0
            for start, x in sorted(found):
                assert start == at and texts[key][0][start : start + len(x)] == x
                at += len(x)
    total = sum(map(len, want))
    assert sorted(windows) == list(range(-(-total // length)))
    mix = {}
    for number, found in windows.items():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (length if number < len(windows) - 1 else total - length * (len(windows) - 1))
        mix[number] = {s: sum(p.length for p in found if p.source == s) for s in {p.source for p in found}}
    return mix


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_documents_are_packed_whole_at_their_shares(spark, block):
    docs = spark.read.parquet(SAMPLE).repartition(3, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    mix = checked(docs, rows, 2048, block_windows=block)
    totals = defaultdict(int)
    for found in mix.values():
        for s, n in found.items():
            totals[s] += n
    all_tokens = sum(totals.values())
    for number, found in mix.items():
        if number < len(mix) - 1:
            for s, n in totals.items():
                assert abs(found.get(s, 0) - 2048 * n / all_tokens) <= 3


def test_given_weights_hold_until_a_source_runs_dry(spark):
    rows = [(i, f"some words of document {i} " * (1 + i % 9), ("a", "b", None)[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"a": 0.6, "b": 0.3, None: 0.1}
    mix = checked(docs, [(i, t) for i, t, _ in rows], 256, weights=weights, block_windows=4)
    left = {s: sum(len(ids_of(t)) for _, t, x in rows if x == s) for s in weights}
    for number in sorted(mix):
        if all(left[s] > 256 for s in weights):
            assert all(abs(mix[number].get(s, 0) - 256 * w) <= 3 for s, w in weights.items())
        for s, n in mix[number].items():
            left[s] -= n
    with pytest.raises(ValueError):
        pack(docs, PATH, weights={"a": 1.0, "b": 0.0, None: 1.0})


def test_edges(spark):
    docs = edge.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    checked(docs, rows, 64, block_windows=16)
    assert pack(edge.empty(spark), PATH).count() == 0
    assert [padded_length(n) for n in (1, 3, 1024, 2047, 2048)] == [1, 2048, 1024, 2048, 2048]


def test_what_queues_give_grows_and_sums_up():
    rng = np.random.default_rng(3)
    for totals, shares in (([5, 1000, 3], [5, 1000, 3]), ([10**13, 7, 10**9], [1e13, 7, 1e9]), ([50, 50, 50], [1, 3, 9]), ([1, 1, 1], [1, 1, 1])):
        q = Queues(np.array(totals, np.int64), np.array(shares, float) / sum(shares))
        points = sorted({0, q.tokens, *rng.integers(0, q.tokens + 1, 60).tolist()})
        before = np.zeros(len(totals), np.int64)
        for n in points:
            given, deficit = q.given(n)
            assert given.sum() == n and (given >= before).all() and (given <= q.totals).all()
            assert (np.abs(deficit) <= 2).all()
            before = given


def test_rounds_give_the_whole_backlog_and_keep_deficits_small():
    rng = np.random.default_rng(4)
    for k in (1, 2, 7, 40):
        shares = rng.random(k) + 1e-6
        shares /= shares.sum()
        backlog = np.floor(shares * 2048 * 50).astype(np.int64)
        backlog[0] += 2048 * 50 - backlog.sum()
        grants = serve(backlog, shares, np.zeros(k), 50, 2048)
        assert (grants.sum(axis=0) == backlog).all() and (grants.sum(axis=1) == 2048).all() and (grants >= 0).all()
        assert (np.abs(np.cumsum(grants, axis=0)[:-2] - np.arange(1, 49)[:, None] * shares * 2048) <= 3).all()
    assert (serve(np.array([3, 0, 9]), np.array([0.9, 0.05, 0.05]), np.zeros(3), 4, 4).sum(axis=1) == [4, 4, 4, 0]).all()
