from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftline.llm.alignment import align_corpus
from siftline.llm.perfect_hash import PerfectHash
from siftline.llm.tokens import ByteLevel, Pieces, read_file

from . import edge

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def peers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), ByteLevel(read_file(A)).token


def tokens_of(text, a, b, token):
    """(id, bytes) of both sides, or nothing where they don't spell a space and the text."""
    if not text:
        return [], []
    left = [(i, token[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    spelled = (" " + text).encode()
    return (left, right) if b"".join(t for _, t in left) == b"".join(t for _, t in right) == spelled else ([], [])


def groups_of(left, right):
    groups, now, i, j, x, y = [], ([], []), 0, 0, 0, 0
    while i < len(left) or j < len(right):
        if x <= y and i < len(left):
            now[0].append(left[i][0])
            x += len(left[i][1])
            i += 1
        else:
            now[1].append(right[j][0])
            y += len(right[j][1])
            j += 1
        if x == y:
            groups.append(now)
            now = ([], [])
    return groups


def brute(texts):
    a, b, token = peers()
    groups = [groups_of(*tokens_of(t, a, b, token)) for t in texts]
    linked = [Counter((p, q) for ga, gb in g for p in ga for q in gb) for g in groups]
    counts = Counter(pair for found in linked for pair in found)
    highest = {}
    for (p, _), n in counts.items():
        highest[p] = max(highest.get(p, 0), n)
    out = []
    for g, found in zip(groups, linked):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((
            sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(found.values()),
            sum(n for (p, q), n in found.items() if counts[p, q] == highest[p]), sum(n * counts[pair] for pair, n in found.items()), text.encode(),
        ))
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r))


def expected(rows):
    return sorted(((i, *found) for (i, _), found in zip(rows, brute([t for _, t in rows]))), key=lambda r: (r[0] is None, r))


def checked(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows_of(align_corpus(docs, A, B, **how))]
    assert got == expected(rows)


def test_equals_brute_force_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SAMPLE).collect()]
    checked(spark, rows)


def test_many_chunks_and_parts_give_the_same(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SAMPLE).limit(60).collect()]
    checked(spark, rows, buckets=3, chunk_pairs=500, step_bytes=400)


def test_groups_without_common_ends_are_counted_in_blocks(spark, monkeypatch):
    from siftline.llm import alignment

    text = "日本語漢字" * 40 + "äöüß" * 60 + "zqxjzqxj" * 30
    a, b, token = peers()
    sides = alignment.Files(A, read_file(A), B, read_file(B)).sides()
    ids = sides.encoded([text])
    of = sides.aligned(*ids)[0]
    want = Counter((p, q) for ga, gb in groups_of(*tokens_of(text, a, b, token)) for p in ga for q in gb)
    for at_once in (1, 2, 7, 1 << 20):
        got = Counter()
        for pair, _, times in alignment.links(of, sides.b.size, at_once):
            for i, p in enumerate(pair.tolist()):
                got[divmod(p, sides.b.size)] += 1 if times is None else int(times[i])
        assert got == want


def test_edges(spark):
    texts = [t for _, t, *_ in edge.rows()]
    docs = edge.documents(spark)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows_of(align_corpus(docs, A, B))]
    assert got == expected([(i, t) for (i, t, *_), _ in zip(edge.rows(), texts)])
    assert align_corpus(edge.empty(spark), A, B).count() == 0


def test_documents_that_a_side_does_not_spell_have_no_tokens(spark):
    checked(spark, [(1, "a▁b"), (2, "plain <s> text </s> <unk> <|endoftext|>"), (3, "ｆｕｌｌ ①"), (4, None), (5, "")])


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 42, n, dtype=np.uint64))
    made = PerfectHash.unpack(PerfectHash.build(keys).pack())
    at = made.index(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and len(made) == len(keys)
    by_index = np.empty_like(keys)
    by_index[at] = keys
    assert (made.verified(keys, by_index) == at).all()
    assert (made.verified(keys + np.uint64(1 << 50), by_index) == -1).all()
    if n:
        with pytest.raises(ValueError):
            PerfectHash.build(np.concatenate([keys, keys[:1]]))


def test_tokens_equal_the_general_library():
    a, b, _ = peers()
    side, pieces = ByteLevel(read_file(A)), Pieces(read_file(B))
    assert side.fast is not None
    texts = ["it's  a\ttest\x1c\x85  <|endoftext|>", "x" * 300_000, " " * 300_000, "日本語 é İ ß ² 😀\x00", *map(chr, range(32, 0x3000, 97))]
    for text, found in zip(texts, side.ids(texts)):
        assert found.tolist() == a.encode(text, add_special_tokens=False).ids
    for text, found in zip(texts[:4], pieces.ids(texts[:4])):
        assert found.tolist() == b.encode(text)
