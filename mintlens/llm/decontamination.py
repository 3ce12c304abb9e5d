"""Benchmark decontamination by SimHash windows the size of the benchmark items.

Texts and items are cut into words (runs of ASCII letters, digits and bytes from 0x80; A-Z lower-cased, so
case, punctuation and spacing do not matter) and 5-word shingles. Items are dealt into size classes
(a class spans an eighth); every text is covered by windows of each class's size, an eighth of the size
apart, and each window gets a 64-bit SimHash. Item fingerprints are indexed in four blocks of 16 bits: a table per
block gives the items within 4 bits of a block's value, and two fingerprints within RADIUS = 19 bits are within 4
bits in one block at least, so no fingerprint within the radius is missed. A candidate is passed over if the known
shingles around it weigh too little for the similarity asked for; the others are verified: the exact weighted-shingle similarity (sum of weights of the common shingles over that of all,
repeats counted; a shingle weighs 1 + log(items / items that have it)) of the item and the best
window of its own size around the candidate must be ``similarity`` or more.

The items are a stated query set held against all texts: they go to the workers in blocks of at most
``ITEMS_A_PASS`` items and ``BYTES_A_PASS`` bytes, one pass over the texts a block. Items with a shingle are counted over
the whole benchmark beforehand, so similarities do not depend on the blocks. Texts are not shuffled.

Defined cases: a null or wordless text or item matches nothing; a text or item of fewer than five words is one
shingle; a text shorter than an item is one window; repeated rows and ids are reported row by row; a null id is reported as null.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow, materialize
from .piece_memo import slices

SHINGLE = 5
RADIUS, BLOCKS = 19, 4              # 19 = 4 * (4 + 1) - 1
SIMILARITY = 0.8
ITEMS_A_PASS, BYTES_A_PASS = 2048, 8 << 20
SLICE = 2 << 20                     # bytes of text handled at once
ROWS = 8192                         # windows fingerprinted at once
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * _ODD[2]
    return a ^ (a >> np.uint64(29))


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes of all texts in a row, number of shingles of each)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    letter = _LETTER[raw]
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    length = ends - starts
    first = np.cumsum(length) - length
    local = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _ODD[0]))
    hashed = _mix(np.add.reduceat(_VALUE[raw[letter]] * power[local], first) + length.astype(np.uint64))
    # shingle i of a text covers its words i .. i + size - 1, or all of a shorter text
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    at = np.repeat(np.cumsum(words) - words, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    short = np.repeat(words, count)
    padded = np.concatenate([hashed, np.zeros(size, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _ODD[1] + np.where(k < short, padded[at + k], np.uint64(0))
    return _mix(out), count


def _running(a: np.ndarray) -> None:
    """Sums down the rows, in place: inside runs of 16 rows, then over the runs."""
    whole = len(a) // 16 * 16
    if whole:
        runs = a[:whole].reshape(-1, 16, a.shape[1])
        for j in range(1, 16):
            runs[:, j] += runs[:, j - 1]
        sums = runs[:, 15].copy()
        _running(sums)
        runs[1:] += sums[:-1, None]
    for i in range(max(1, whole), len(a)):
        a[i] += a[i - 1]


def ones_before(hashes: np.ndarray, widest: int) -> np.ndarray:
    """(n + 1, 64): how many of the first i hashes have each bit set, modulo more than ``widest``."""
    out = np.zeros((len(hashes) + 1, 64), np.uint8 if widest < 256 else np.uint32)
    out[1:] = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    _running(out)
    return out


def window_fingerprints(ones: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the shingles start .. end - 1 of each window (a bit is set in more than half of them)."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), ROWS):
        a, b = start[lo:lo + ROWS], end[lo:lo + ROWS]
        half = ((b - a) // 2).astype(ones.dtype)[:, None]
        set_in = ones.take(b, axis=0)
        set_in -= ones.take(a, axis=0)
        out[lo:lo + ROWS] = np.packbits(set_in > half, axis=1, bitorder="little").view("<u8").ravel()
    return out


class Block(NamedTuple):
    items: tuple[tuple[object, bytes], ...]
    total: int          # items of the whole benchmark that have a shingle
    shared: bytes       # the block's shingles that several items of the benchmark have, as 64-bit hashes
    have: bytes         # by how many items each


class Items:
    """Fingerprints, shingles and block tables of one block of benchmark items. Shingles weigh by ``total`` and ``shared``
    (items that have a shingle) of the whole benchmark; without them the items are the benchmark."""

    def __init__(self, items: tuple[tuple[object, bytes], ...], total: int | None = None, shared: dict[int, int] | None = None):
        hashes, count = shingles([t for _, t in items])
        cuts = np.concatenate([[0], np.cumsum(count)])
        some = [k for k in range(len(items)) if count[k]]
        self.ids = [items[k][0] for k in some]
        self.shingles = [hashes[cuts[k]:cuts[k + 1]] for k in some]
        have = Counter(h for s in self.shingles for h in set(s.tolist()))
        if shared is not None:
            have = {h: shared.get(h, 1) for h in have}
        total = len(some) if total is None else total
        self.top_weight = 1 + math.log(max(1, total))
        self.weight = {h: 1 + math.log(total / n) for h, n in have.items()}
        self.known = np.zeros(1 << 22, np.float32)   # greatest weight of any item's shingles with these low bits
        np.maximum.at(self.known, np.array(list(have), np.uint64).astype(np.int64) & 0x3FFFFF,
                      np.array([self.weight[h] for h in have], np.float32))
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.total = [sum(self.weight[h] * n for h, n in c.items()) for c in self.counts]
        self.postings: dict[int, list[int]] = {}
        for k, c in enumerate(self.counts):
            for h in c:
                self.postings.setdefault(h, []).append(k)
        # the sizes of classes are 4 .. 8 times a power of two
        self.classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.shingles):
            step = 1 << max(0, len(s).bit_length() - 3)
            self.classes.setdefault(max(1, round(len(s) / step) * step), []).append(k)
        self.fingerprints = np.array([window_fingerprints(ones_before(s, len(s)), np.array([0]), np.array([len(s)]))[0]
                                      for s in self.shingles], np.uint64)
        near = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1)
                         for bits in itertools.combinations(range(16), r)])
        self.tables: dict[int, list[tuple[list[int], np.ndarray]]] = {}
        for size, members in self.classes.items():
            for lo in range(0, len(members), 64):
                group = members[lo:lo + 64]
                table = np.zeros((BLOCKS, 1 << 16), np.uint64)
                for j, k in enumerate(group):
                    for b in range(BLOCKS):
                        value = int(self.fingerprints[k]) >> (16 * b) & 0xFFFF
                        table[b, near ^ value] |= np.uint64(1 << j)
                self.tables.setdefault(size, []).append((group, table))

    def candidates(self, size: int, prints: np.ndarray):
        """(item, windows) of the class ``size`` whose fingerprints are within RADIUS bits."""
        blocks = prints.view("<u2").reshape(-1, BLOCKS)
        for group, table in self.tables[size]:
            met = table[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                met |= table[b][blocks[:, b]]
            some = np.nonzero(met)[0]
            met, near = met[some], prints[some]
            for j, k in enumerate(group):
                at = np.nonzero(met & np.uint64(1 << j))[0]
                at = at[np.bitwise_count(near[at] ^ self.fingerprints[k]) <= RADIUS]
                if len(at):
                    yield k, some[at]

    def similarity(self, k: int, window: list[int]) -> float:
        """Exact weighted similarity of item ``k`` and a window's shingles."""
        mine, theirs = self.counts[k], Counter(window)
        weight = self.weight.get
        common = sum(weight(h) * min(n, theirs[h]) for h, n in mine.items() if h in theirs)
        every = sum(weight(h) * max(n, theirs[h]) for h, n in mine.items())
        every += sum(weight(h, self.top_weight) * n for h, n in theirs.items() if h not in mine)
        return common / every if every else 0.0

    def best_window(self, k: int, doc: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
        """(similarity, start) of the best window of item ``k``'s size that starts in lo .. hi."""
        n = min(len(self.shingles[k]), len(doc))
        best = (0.0, 0)
        held = np.array([h in self.counts[k] for h in doc[max(0, lo):hi + n].tolist()])
        for a in range(max(0, lo), min(hi, len(doc) - n) + 1):
            if held[a - max(0, lo):a - max(0, lo) + n].any():
                best = max(best, (self.similarity(k, doc[a:a + n].tolist()), -a))
        return best[0], -best[1]

    def short_matches(self, hashes: np.ndarray, base: np.ndarray, count: np.ndarray, known: np.ndarray, similarity: float):
        """(text, item) where the text has fewer shingles than a window of the item's class and may be similar. Such a text lacks
        whole shingles of the item, light ones perhaps, so fingerprints, which know no weights, do not bound it: the
        weight that it has in common with each item is added up instead. Texts whose known shingles together weigh too little for
        any larger item are passed over."""
        size_of = np.zeros(len(self.ids), np.int64)
        for size, members in self.classes.items():
            size_of[members] = size
        need = similarity * np.array(self.total) * 0.9999
        order = np.argsort(size_of)
        sizes, least = size_of[order], np.minimum.accumulate(need[order][::-1])[::-1]     # of the items from here on
        at = np.searchsorted(sizes, count, side="right")        # the first item of a larger class
        whole = known[base + count] - known[base]
        larger = at < len(order)
        some = np.nonzero(larger & (count > 0) & (whole >= least[np.minimum(at, len(order) - 1)]))[0] if len(order) else []
        for d in some:
            common: dict[int, float] = {}
            for h, n in Counter(hashes[base[d]:base[d] + count[d]].tolist()).items():
                for k in self.postings.get(h, ()):
                    common[k] = common.get(k, 0.0) + self.weight[h] * min(n, self.counts[k][h])
            for k, w in common.items():
                if size_of[k] > count[d] and w >= need[k]:
                    yield int(d), k

    def matches(self, texts: list[bytes], similarity: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each text and item."""
        hashes, count = shingles(texts)
        if not len(hashes):
            return []
        base = np.cumsum(count) - count
        ones = ones_before(hashes, max(self.tables, default=0))
        known = np.concatenate([[0.0], np.cumsum(self.known[hashes.astype(np.int64) & 0x3FFFFF], dtype=float)])
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size in self.tables:
            step = max(1, size // 8)
            # windows of a text: step apart, and one that ends with the text
            windows = np.where(count >= size, -(-(count - size) // step) + 1, 0)
            text = np.repeat(np.arange(len(texts)), windows)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = np.minimum(nth * step, np.maximum(count[text] - size, 0))
            end = np.minimum(start + size, count[text])
            prints = window_fingerprints(ones, base[text] + start, base[text] + end)
            for k, at in self.candidates(size, prints):
                reach = step + abs(len(self.shingles[k]) - size) + 1
                lo, hi = np.maximum(start[at] - reach, 0), start[at] + reach
                t = text[at]
                # common shingles weigh at least this share of the item, and no more than the known ones here
                around = known[np.minimum(base[t] + hi + len(self.shingles[k]), base[t] + count[t])] - known[base[t] + lo]
                near = around >= 0.9999 * similarity * self.total[k]
                for d, a, b in zip(t[near].tolist(), lo[near].tolist(), hi[near].tolist()):
                    spans.setdefault((d, k), []).append((a, b))
        for d, k in self.short_matches(hashes, base, count, known, similarity):
            spans.setdefault((d, k), []).append((0, int(count[d])))
        out = []
        for (d, k), some in sorted(spans.items()):
            doc = hashes[base[d]:base[d] + count[d]]
            best, reached = (0.0, 0), -1
            for a, b in sorted(some):               # overlapping ranges are searched once
                if b > reached:
                    score, at = self.best_window(k, doc, max(a, reached + 1), b)
                    best, reached = max(best, (score, -at)), b
            if best[0] >= similarity:
                out.append((d, k, best[0], -best[1], min(len(self.shingles[k]), len(doc)) + SHINGLE - 1))
        return out


@lru_cache(maxsize=1)
def _items(block: Block) -> Items:
    return Items(block.items, block.total, dict(zip(np.frombuffer(block.shared, np.uint64).tolist(),
                                                    np.frombuffer(block.have, np.int64).tolist())))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    rows = benchmark.select(F.col(item_col).alias("item"),
                            F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                hashes, count = shingles(part.column(1).to_pylist())
                own = [np.unique(h) for h in np.split(hashes, np.cumsum(count)[:-1])]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))],
                    ["item", "body", "own"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    items = materialize(map_arrow(rows, run, f"item {kind}, body binary, own array<bigint>").withColumn(
        "at", F.monotonically_increasing_id()), "benchmark")
    each = items.select("at", F.explode("own").alias("h"))
    several = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(several, "h").groupBy("at").agg(F.collect_list(F.struct("h", "n")).alias("shared"))
    total = items.where(F.size("own") > 0).count()

    def block() -> Block:
        return Block(tuple(held), total, np.array(list(have), np.int64).tobytes(), np.array(list(have.values()), np.int64).tobytes())

    held, have, size = [], {}, 0
    for item, text, mine in items.join(shared, "at", "left").orderBy("at").select("item", "body", "shared").toLocalIterator():
        if held and (len(held) >= ITEMS_A_PASS or size + len(text) > BYTES_A_PASS):
            yield block()
            held, have, size = [], {}, 0
        held.append((item, bytes(text)))
        have.update(mine or ())
        size += len(text)
    yield block()


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): every text and item that match, with the best window."""
    sc = docs.sparkSession.sparkContext
    id_type, item_type = (docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def one_pass(block) -> DataFrame:
        def run(batches):
            items = _items(block.value)
            for batch in batches:
                for part in slices(batch, 1, SLICE):
                    found = items.matches([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()], similarity)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                         pa.array([items.ids[f[1]] for f in found], id_arrow),
                         *(pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return map_arrow(rows, run, f"doc_id {id_type}, item_id {item_type}, similarity double, first_word bigint, n_words bigint")

    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        found = one_pass(sc.broadcast(block))
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    sc = docs.sparkSession.sparkContext

    def one_pass(rows: DataFrame, block) -> DataFrame:
        def keep():
            items = _items(block.value)

            def test(column):
                out = np.ones(len(column), bool)
                batch, lo = pa.RecordBatch.from_arrays([column], ["text"]), 0
                for part in slices(batch, 0, SLICE):
                    found = items.matches([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()], similarity)
                    out[[lo + f[0] for f in found]] = False
                    lo += part.num_rows
                return out
            return test

        return keep_rows(rows, text_col, keep)

    for block in _blocks(benchmark, item_col, item_text_col):
        docs = one_pass(docs, sc.broadcast(block))
    return docs
