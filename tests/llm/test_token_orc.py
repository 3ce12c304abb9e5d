import glob
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.orc
from tokenizers import Tokenizer

from mintlens.llm import queries as Q
from mintlens.llm import token_orc as O
from mintlens.llm.common import scratch_path

from .corpus import DOCS, frame, rows

PATH = P.path("byte_bpe_50k.json")


def want():
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    out, start = [], 0
    for i, t, _ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_index_and_files(spark):
    out = scratch_path(spark, "test-orc")
    O.write(frame(spark, clash=True).repartition(5), out, PATH, P.PATTERN)
    got = sorted(map(tuple, O.index(O.read(spark, out)).collect()), key=lambda r: r[1])
    assert got == want()
    files = glob.glob(out.removeprefix("file:") + "/*.orc")
    assert files and sum(pyarrow.orc.ORCFile(f).nrows for f in files) == len(got)


def test_lookup_is_pushed_down(spark):
    out = scratch_path(spark, "test-orc")
    O.write(frame(spark), out, PATH, P.PATTERN)
    found = O.lookup(spark, out, [3, 105])
    assert sorted(r.doc_id for r in found.collect()) == [3, 105]
    assert "In(doc_id" in found._jdf.queryExecution().toString()


def test_empty_table(spark):
    out = scratch_path(spark, "test-orc")
    O.write(spark.createDataFrame([], DOCS), out, PATH, P.PATTERN)
    assert O.index(O.read(spark, out, O.SCHEMA.format("bigint"))).collect() == []


def test_added_tokens_like_the_unmodified_library(spark, monkeypatch):
    data = rows() + [(200, "a <|endoftext|> b", "en"), (201, "<|endoftext|><|endoftext|>", "en"),
                     (202, "x <|endoftext|>\n\n y<|endoftext|", "en"), (203, "é<|endoftext|>'s  ", "fr"), (204, "plain", "en")]
    lib = Tokenizer.from_file(PATH)
    assert lib.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    want, start = [], 0
    for i, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    monkeypatch.setattr(Q, "table", lambda *_: frame(spark, data))
    assert sorted(map(tuple, Q.op4_token_orc(spark, "").collect()), key=lambda r: r[1]) == want


def test_a_worker_holds_one_tokenizer_and_few_encodings(monkeypatch):
    for cached in (O.tokenizer, O.library, O.ordinary):
        cached.cache_clear()
    monkeypatch.setattr(O, "AT_ONCE", 1)
    monkeypatch.setattr(O, "JOINED", 3)
    memo = O.tokenizer(PATH, P.PATTERN)
    texts = [" ".join(f"word{k}x{j}" for j in range(20)) for k in range(30)] + [None, ""]
    flat, count = O.encode(memo, PATH, pa.array(texts), added_tokens=True)
    assert O.library.cache_info().currsize == O.ordinary.cache_info().currsize == 0
    want = [O.library(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [k for ids in want for k in ids] and count.tolist() == [len(ids) for ids in want]
