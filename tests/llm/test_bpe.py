import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from siftline.llm.bpe import decode, encode, merge, read_ranks

from . import edge

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
PEER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "​", " ", "　", "'s", "'LL", "1", "²", "é", "é", "日本", "😀", "<|endoftext|>", "##", "\x00", "İ", "ß"]


def both(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()


def test_equals_the_usual_encoder_and_decodes_back(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))) for i in range(400)]
    for row in both(spark, rows):
        ids = np.frombuffer(row.token_ids, "<u4").tolist()
        assert ids == PEER.encode_ordinary(row.text) and len(ids) == row.n_tokens
        assert bytes(row.decoded) == row.text.encode()


def test_long_pre_tokens():
    for text in ("a" * 50_000, "ab" * 20_000, "thethe" * 5000):
        assert merge(text.encode(), RANKS) == PEER.encode_ordinary(text)


def test_equal_ranks_merge_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ba": 258}
    peer = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("aaaaa", "aabaaab", "baab", "ababaa"):
        assert merge(text.encode(), ranks) == peer.encode_ordinary(text)


def test_edges(spark):
    docs = edge.documents(spark)
    out = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert set(out.columns) == set(docs.columns)
    for row in out.collect():
        assert bytes(row.decoded) == (row.text or "").encode() and row.n_tokens == len(PEER.encode_ordinary(row.text or ""))
    assert encode(edge.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_words_at_single_spaces_and_other_patterns(spark):
    rng = random.Random(9)
    words = ["it's", "a", "end.", "x\n\ny", "don't,", "'ll", "12", "--", "(é)", "日本", "\ty", "z\x1f"]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", " \n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 30))) + rng.choice(["", " ", "\n "])) for i in range(300)]
    for row in both(spark, rows):
        assert np.frombuffer(row.token_ids, "<u4").tolist() == PEER.encode_ordinary(row.text)
    other = r" ?[a-z]+ ?|[^a-z]"
    peer = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=RANKS, special_tokens={})
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for row in encode(docs, PATH, other).collect():
        assert np.frombuffer(row.token_ids, "<u4").tolist() == peer.encode_ordinary(row.text)


def test_lower_ranks_that_appear_go_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"abab": 259, b"cab": 260}
    rng = random.Random(5)
    peer = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
        assert merge(text.encode(), ranks) == peer.encode_ordinary(text)


def test_rank_file():
    line = open(PATH, "rb").readline().split()
    assert RANKS[base64.b64decode(line[0])] == int(line[1])
