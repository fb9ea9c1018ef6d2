import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from vecloom.llm import byte_bpe, token_counts

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "漢", "🎉", "'s", "'re", "1", "23", "--", "▁", "　", "\xa0", "\x1c", "\x85", "\x00", "The", " the", "<s>", "<|endoftext|>", "ing", "tion", "​", "é", "²", "ⅷ", "ﬁ"]


def fuzz(n=800):
    rnd = random.Random(1)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    made += ["".join(rnd.choice("abcdefghij") for _ in range(m)) for m in (47, 48, 49, 96, 97, 100, 500, 5000)]
    return made + ["a" * m for m in (48, 49, 64, 100, 20_000)] + ["ab" * 500, "-" * 3000, " " * 5000, "\n" * 300 + "x", "é" * 2000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_like_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.PieceCounter(PIECES).count(fuzz()) == [len(x) for x in model.encode(fuzz())]


def test_counts_with_a_full_dictionary(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.PieceCounter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in fuzz(50):
        assert counter.count([text]) == [len(model.encode(text))]


def test_count_rows(spark, odd, odd_rows, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(str, map(tuple, token_counts.count_tokens(odd, PIECES, 100).collect())))
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in odd_rows]
    assert got == sorted(map(str, want))
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_encodes_like_the_library(library):
    bpe = byte_bpe.vocabulary(RANKS, P.PATTERN)
    for text in fuzz():
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_tree_is_the_plain_merge_at_any_leaf(monkeypatch):
    bpe = byte_bpe.vocabulary(RANKS, P.PATTERN)
    rnd = random.Random(2)
    pieces = [("".join(rnd.choice(["th", "e", "ing", "a", "tion", "é", "x"]) for _ in range(rnd.randint(1, 40)))).encode() for _ in range(200)]
    plain = [bpe.merge(p) for p in pieces]
    for leaf in (1, 2, 7, 48):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        assert [bpe.encode_tree(p) for p in pieces] == plain


def test_documents_go_through_the_tree(monkeypatch):
    """Every match of the given documents that is no token is joined from halves, and ids are concatenated up a tree."""
    import pyarrow.parquet as pq

    joins, halves, depth = [], [], []
    join, decode_tree, encode_tree = byte_bpe.ByteBPE.join, byte_bpe.ByteBPE.decode_tree, byte_bpe.ByteBPE.encode_tree

    def counted(self, left, right):
        joins.append(b"".join(left + right))
        return join(self, left, right)

    def entered(self, piece):
        depth.append(piece)
        return encode_tree(self, piece)

    def spelled(self, ids):
        halves.append(len(ids))
        return decode_tree(self, ids)

    monkeypatch.setattr(byte_bpe.ByteBPE, "join", counted)
    monkeypatch.setattr(byte_bpe.ByteBPE, "encode_tree", entered)
    monkeypatch.setattr(byte_bpe.ByteBPE, "decode_tree", spelled)
    bpe = byte_bpe.ByteBPE.from_file(RANKS, P.PATTERN)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    assert all(bpe.decode(bpe.encode(t)) == t.encode() for t in texts)
    other = {m.encode() for t in texts for m in bpe.split(t)} - set(bpe.ranks)
    assert {m for m in other if len(m) > byte_bpe.LEAF} <= set(joins) and {m for m in other} <= set(depth) and len(set(joins) & other) > len(other) / 2
    assert len(halves) > 4 * len(texts)


def test_long_matches_take_no_square_time():
    import time

    bpe = byte_bpe.vocabulary(RANKS, P.PATTERN)
    start = time.monotonic()
    for piece in (b"a" * 20_000, b"ab" * 10_000, b"-" * 20_000, "é漢".encode() * 4000, bytes(random.Random(3).choices(b"abcdefghijklmnop", k=20_000))):
        bpe.encode_tree(piece)
    assert time.monotonic() - start < 30


def test_white_space_is_that_of_the_library(library):
    bpe = byte_bpe.vocabulary(RANKS, P.PATTERN)
    text = "".join(f"a{chr(c)}{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_rows(spark, odd, odd_rows, nothing, library):
    got = sorted(map(str, (tuple(r) for r in byte_bpe.encode(odd, RANKS, P.PATTERN).collect())))
    want = []
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(map(str, want))
    assert byte_bpe.encode(nothing, RANKS, P.PATTERN).count() == 0
