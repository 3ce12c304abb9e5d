"""Byte-level BPE with a rank file, in numpy matrices.

Distinct pattern matches are dealt into buckets of similar byte length, one padded
matrix row each. In every round each row merges its leftmost pair of least rank; pair ranks come
from a hash table over (left id, right id), and dropping one column entry a row keeps the
matrix compact. Rows without a mergeable pair leave the matrix. Matches beyond
``LONG`` bytes, for which rounds over a row would cost the square of its length, merge the
same pairs in the same order from a heap.

Defined cases: null text is encoded as an empty text (no ids); white space, control
characters and text of any length are encoded whole; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .piece_memo import PieceMemo, slices

NONE = np.iinfo(np.int32).max     # rank of a pair that does not merge
LONG = 512                        # bytes of a match from which the heap takes over
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, LONG)
CELLS = 1 << 20                   # cells of one matrix
SLICE = 4 << 20                   # bytes of text encoded at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        to = np.array(to, np.int32)
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            taker = np.full(1 << self.bits, -1)
            taker[slot[todo[free]]] = todo[free]          # of those that want a slot, one gets it
            won = todo[free][taker[slot[todo[free]]] == todo[free]]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], to[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they do not merge or an id is negative (padding)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        todo = np.nonzero((held != keys) & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [b"%d" % k for k in range(len(self.token))]
        self.memo = PieceMemo(pattern, self.encode_pieces)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_id[raw]
        ranks = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[np.ndarray] = [None] * n
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            go = least != NONE
            for r, x in zip(row[~go].tolist(), ids[~go]):
                out[r] = x[x >= 0]
            row, ids, ranks, at, least = row[go], ids[go], ranks[go], at[go], least[go]
            if not len(row):
                break
            here = np.arange(len(row))
            ids[here, at] = least          # the merged token's id is its rank
            keep = np.ones(ids.shape, bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(ranks.shape, bool)
            keep[here, at] = False
            ranks = ranks[keep].reshape(len(row), -1)
            has = at > 0                   # the two pairs that the merged token is part of
            ranks[here[has], at[has] - 1] = self.table(ids[here[has], at[has] - 1], ids[here[has], at[has]])
            has = at < ranks.shape[1]
            ranks[here[has], at[has]] = self.table(ids[here[has], at[has]], ids[here[has], at[has] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long match: least rank first, leftmost among equals."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.ranks.get

        def offer(k: int) -> None:
            if after[k] < len(parts) and (r := rank(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]), len(parts[after[k]])))

        heap: list[tuple[int, int, int, int]] = []
        for k in range(len(parts)):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if parts[k] is None or len(parts[k]) != a or n >= len(parts) or len(parts[n]) != b:
                continue                   # one of the two has been merged meanwhile
            parts[k] += parts[n]
            parts[n] = None
            after[k] = after[n]
            if after[n] < len(parts):
                before[after[n]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of pattern matches."""
        raw = [p.encode() for p in pieces]
        out: list[np.ndarray] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(raw):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = np.array([whole], np.int32)
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(p) <= w), 0), []).append(k)
        for width, some in buckets.items():
            step = max(1, CELLS // width) if width else 1
            for lo in range(0, len(some), step):
                now = some[lo:lo + step]
                done = self._merge_rows([raw[k] for k in now], width) if width else [self._merge_long(raw[now[0]])]
                for k, x in zip(now, done):
                    out[k] = x
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        flat, count = self.memo.encode(texts)
        return np.split(flat, np.cumsum(count)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[k] for k in ids.tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process and rank file."""
    return ByteBpe(read_ranks(path), pattern)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kind


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                flat, count = bpe.memo.encode(part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    narrow, kind = _narrow(docs, id_col, text_col)
    return map_arrow(narrow, run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of every row of ids; null ids decode to nothing."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, run, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded again."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = bpe.encode(part.column(1))
                decimal = bpe.decimal
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join([decimal[k] for k in x.tolist()])).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow, kind = _narrow(docs, id_col, text_col)
    return map_arrow(narrow, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
