import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from mintlens.llm import byte_bpe as B

from .corpus import DOCS, frame, rows

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_like_the_library(spark, library):
    got = sorted(map(tuple, B.round_trip(frame(spark, clash=True), PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_random_texts(library):
    rng = random.Random(9)
    chars = list("ab c  \n\t'sé \x1c\x85\x0b !?1²漢😀tT") + ["'re", "<|endoftext|>", "the", "   "]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 700, "ab" * 3000, "x y" * 500 + " ", "!" * 1500, "the" * 900]
    bpe = B.codec(PATH, P.PATTERN)
    for lo in range(0, len(texts), 500):
        some = texts[lo:lo + 500]
        got = bpe.encode(pa.array(some))
        assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in some]
        assert [bpe.decode(x) for x in got] == [t.encode() for t in some]


def test_long_match_like_the_matrix(library):
    bpe = B.codec(PATH, P.PATTERN)
    piece = b"".join(random.Random(2).choice([b"th", b"e", b"in", b"xq", b"a"]) for _ in range(300))
    assert bpe._merge_long(piece).tolist() == bpe._merge_rows([piece], 1024)[0].tolist() == library.encode_ordinary(piece.decode())
    assert len(bpe.encode(pa.array(["lorem" * 60_000]))[0]) == len(library.encode_ordinary("lorem" * 60_000))


def test_memo_starts_anew(library):
    bpe = B.ByteBpe(B.read_ranks(PATH), P.PATTERN)
    bpe.memo.chunk_limit = bpe.memo.piece_limit = 50
    for seed in range(4):
        texts = [t or "" for _, t, _ in rows(seed, 20)]
        assert [x.tolist() for x in bpe.encode(pa.array(texts))] == [library.encode_ordinary(t) for t in texts]
        assert bpe.memo.chunks.n <= 1 + len(bpe.memo.place)


def test_pair_table_finds_all_and_no_other():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    table = B.PairTable(ranks)
    left, right = np.array([97, 256, 97, 98, 97, -1]), np.array([98, 99, 258, 99, 97, 3])
    assert table(left, right).tolist() == [256, 257, 257, 258, B.NONE, B.NONE]


def test_encode_and_decode_frames(spark, library):
    docs = frame(spark)
    enc = B.encode(docs, PATH, P.PATTERN)
    assert sorted((r.doc_id, r.ids) for r in enc.where("doc_id < 100").collect()) == [
        (i, library.encode_ordinary(t or "")) for i, t, _ in rows() if i is not None and i < 100]
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(enc, PATH, P.PATTERN).where("doc_id < 100").collect()}
    assert all(back[i] == (t or "").encode() for i, t, _ in rows() if i is not None and i < 100)


def test_empty_table(spark):
    assert B.round_trip(spark.createDataFrame([], DOCS), PATH, P.PATTERN).collect() == []
