"""Token ids as ORC: sorted by document id, read back stripe by stripe.

Documents are range-partitioned by id and sorted inside their partition; each task encodes its
range and writes one run of ORC files. ORC stores the ids with integer run-length encoding, keeps min/max
row indexes per row group, and gets Bloom filters on the id, so a look-up of documents skips
whole stripes (:func:`lookup`) and a full read is split by stripes.

Every row carries its place: ``part`` (the range), ``part_start`` (ids of its range before it) and
``n_tokens``. The place in the whole corpus follows from one total a range, so no task ever
sees more than its own range.

Defined cases: null text is an empty text (the end id alone); null ids sort first; equal ids are
ordered by their text and all kept; an empty table writes no rows. The string of an added token of the tokenizer's file
(<|endoftext|>) in a text is ordinary text, or with ``added_tokens`` that token, as in the library by default.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow
from .piece_memo import SEPARATOR, PieceMemo, Ragged, slices

JOINED = 256         # pieces encoded as one text
AT_ONCE = 32         # such texts that the library holds at a time: its encodings are many times their ids
SLICE = 8 << 20      # bytes of text handled at once
STRIPE_BYTES = 64 << 20
SCHEMA = "doc_id {}, part int, part_start bigint, n_tokens bigint, ids array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> PieceMemo:
    """The library's tokenizer behind a memo of distinct pattern matches; one for each worker."""
    from tokenizers import Tokenizer, pre_tokenizers

    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True     # their strings in a text are ordinary text
    # the pattern has been applied: what stands between separators is one piece
    lib.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(SEPARATOR, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    # every byte is one character of the vocabulary's strings, so a token's length is its bytes'
    size = np.zeros(lib.get_vocab_size(), np.int64)
    for token, k in lib.get_vocab(with_added_tokens=False).items():
        size[k] = len(token)

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are encoded many in a text, and their ids told apart by the bytes they cover; the few that hold the
        separator are encoded one by one."""
        order = [k for k, p in enumerate(pieces) if SEPARATOR not in p]
        many = len(order)
        some = [pieces[k] for k in order]
        texts = [SEPARATOR.join(some[lo:lo + JOINED]) for lo in range(0, many, JOINED)]
        parts = [np.array([k for e in lib.encode_batch_fast(texts[at:at + AT_ONCE], add_special_tokens=False) for k in e.ids], np.int32)
                 for at in range(0, len(texts), AT_ONCE)]
        ids = np.concatenate([np.empty(0, np.int32), *parts])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, many))
        count = np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)
        if many < len(pieces):
            order += [k for k, p in enumerate(pieces) if SEPARATOR in p]
            rest = [e.ids for e in ordinary(path).encode_batch_fast([pieces[k] for k in order[many:]], add_special_tokens=False)]
            ids = np.concatenate([ids, np.array([k for some in rest for k in some], np.int32)])
            count = np.concatenate([count, [len(x) for x in rest]])
        back = Ragged()
        back.extend(ids, count.astype(np.int64))
        return (ids, count) if many == len(pieces) else back.take(np.argsort(np.array(order)))

    memo = PieceMemo(pattern, encode_pieces)
    memo.added_tokens = [t.content for t in lib.get_added_tokens_decoder().values()]
    return memo


@lru_cache(maxsize=2)
def ordinary(path: str):
    """The library's tokenizer, to which strings of added tokens are ordinary text; loaded for the few pieces that need it."""
    lib = library.__wrapped__(path)
    lib.encode_special_tokens = True
    return lib


@lru_cache(maxsize=2)
def library(path: str):
    """The library's tokenizer as its file says; loaded with the first text that holds an added token."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(memo: PieceMemo, path: str, texts: pa.Array, added_tokens: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each). The memo cannot see added tokens: with ``added_tokens`` the texts
    that hold one go to the library whole."""
    if not added_tokens or not len(texts):
        return memo.encode(texts)
    strings = memo.added_tokens
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    lo, hi = np.frombuffer(offsets, np.int32)[[texts.offset, texts.offset + len(texts)]].tolist()
    data = data.slice(lo, hi - lo).to_pybytes() if data else b""
    if not any(some.encode() in data for some in strings):
        return memo.encode(texts)
    raw = pc.fill_null(texts, b"")
    held = np.zeros(len(raw), bool)
    for some in strings:
        held |= pc.match_substring(raw, some).to_numpy(zero_copy_only=False)
    flat, count = memo.encode(pc.if_else(pa.array(held), pa.scalar(b"", pa.binary()), raw))
    some = [x.decode("utf-8", "replace") for x in raw.filter(pa.array(held)).to_pylist()]
    ids = [e.ids for e in library(path).encode_batch_fast(some, add_special_tokens=False)]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    at = np.repeat(np.cumsum(count)[held], sizes)
    count = count.copy()
    count[held] = sizes
    return np.insert(flat, at, np.array([k for x in ids for k in x], flat.dtype)), count


def with_end(flat: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with ``end_id`` after each."""
    return np.insert(flat, np.cumsum(count), end_id).astype(np.int32), count + 1


def encode_sorted(docs: DataFrame, path: str, pattern: str, end_id: int = 0,
                  id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """The rows to write: range-partitioned and sorted by id, with their place in the range."""

    def run(batches):
        memo, part, start = tokenizer(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                flat, count = with_end(*encode(memo, path, some.column(1), added_tokens), end_id)
                begins = start + np.cumsum(count) - count
                start += int(count.sum())
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(count), part, np.int32)), pa.array(begins), pa.array(count),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), run, SCHEMA.format(kind))


def write(docs: DataFrame, out: str, path: str, pattern: str, end_id: int = 0,
          id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> None:
    """Writes the corpus below ``out``: ORC, ids ascending from file to file."""
    (encode_sorted(docs, path, pattern, end_id, id_col, text_col, added_tokens).write
     .option("compression", "zstd").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(out))


def read(spark: SparkSession, out: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).orc(out)


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: an IN list on the id is pushed down to the stripes' statistics,
    row indexes and Bloom filters."""
    return read(spark, out).where(F.col("doc_id").isin(*doc_ids))


def index(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written rows: the place in the whole corpus and a checksum
    of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(4)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            cuts = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())],
                                             ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    ranges = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))     # one row a range
    before = ranges.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sums = map_arrow(rows.select("doc_id", "part", "part_start", "n_tokens", "ids"), run,
                     f"doc_id {kind}, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return sums.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
