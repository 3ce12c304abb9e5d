"""Language-model scores from a log-frequency Bloom filter.

All n-grams of the training texts are counted: tasks sum their own n-grams, and blocks of
(hash, count) pairs are merged by hash range. A count c is quantised to level 1 + floor(log_1.5 c) and the
n-gram enters the filter once for every level up to its own. A look-up probes level after level until one is
missing, which gives the quantised count back. The filter holds every n-gram and grows
with the training texts. It is made of one segment for each order and hash range, built where that range was counted.

A filter of at most ``MAX_FILTER_BYTES`` with a vocabulary of at most ``MAX_VOCABULARY`` tokens is broadcast, and n-grams
are probed where they are used. A larger one never passes through the driver: texts are tokenised once into bundles,
each bundle asks for its distinct n-grams by hash range, every range answers from its own segment, and the answers meet
the bundle's texts again. That is a fixed number of passes and shuffles however large the filter is. Both ways probe the
same bits and give the same scores.

P(w | v) = a P_ml(w | v) + (1 - a) P(w), down to (c + 1) / (N + V + 1) for single tokens; a is
chosen for every order and context level by deleted interpolation (a training token's own occurrence taken
off) over all training documents. A probability depends on the levels at its place alone, so texts are looked up once:
the levels at each place are written (``STATE_BITS`` a level), and both tuning and scoring read those.

The base score uses exact counts, from the vocabulary that is broadcast beside the filter or from the range that counted
the token.

Tokens are hashed to 64 bits. Defined cases: null text is empty (its end token alone is scored); documents with a
null id are held out; with nothing to learn from, N = V = 0; equal rows are scored alike.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .piece_memo import slices

ORDER = 2
LEVEL_BASE = 1.5
BITS_A_KEY, PROBES = 10, 5
STATE_BITS = 7                          # of a level
MAX_FILTER_BYTES = 128 << 20            # of a filter that is broadcast
MAX_VOCABULARY = 8 << 20                # tokens whose exact counts are broadcast
SLICE = 1 << 20                         # bytes of text handled at once
BUNDLE = 4 << 20                        # bytes of text that ask together
ASKED_BYTES = 64 << 20                  # of n-grams that one task answers, about
BUFFER = 1 << 21                        # n-grams a counting task holds before it sums them up
RANGE_TOKENS = 1 << 20                  # n-gram occurrences of a hash range, about
WEIGHTS = np.linspace(0.0, 0.95, 20)    # candidates for the interpolation weight
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))     # no token holds white space
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * _ODD[1]
    return a ^ (a >> np.uint64(32))


class Tokens(NamedTuple):
    grams: list[np.ndarray]     # by order: hash of the n-gram that ends at each place
    place: np.ndarray           # place in its text; 0 is the mark before the first token
    owner: np.ndarray           # text of each place
    counts: np.ndarray          # tokens of each text, with the end


def tokens(texts: list[bytes], order: int) -> Tokens:
    """The n-gram hashes of texts, each framed by end marks."""
    words = [t.lower().split() for t in texts]      # splits at \x20 and \x09-\x0D, lower-cases A-Z
    n = np.fromiter(map(len, words), np.int64, len(words))
    sizes = n + 2
    ends = np.cumsum(sizes)
    one = np.full(int(sizes.sum()), END)
    inner = np.ones(len(one), bool)
    inner[ends - 1] = inner[ends - sizes] = False
    digest = xxhash.xxh64_intdigest
    one[inner] = np.array([digest(w, 42) for some in words for w in some], np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    grams = [one]
    for _ in range(1, order):
        before = np.concatenate([one[:1], grams[-1][:-1]])
        grams.append(_mix(before * _ODD[0] + one * _ODD[2]))
    return Tokens(grams, np.arange(len(one)) - np.repeat(ends - sizes, sizes), owner, n + 1)


def level(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """1 for the least kept count, one more for each factor of LEVEL_BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, least) / least) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_counts(least: int = 1, most: int = 128) -> np.ndarray:
    """Count that stands for each level: the middle of its whole numbers; 0 for level 0."""
    edges = np.ceil(least * LEVEL_BASE ** np.arange(most + 1) - 1e-9)
    return np.concatenate([[0.0], np.sqrt(edges[:-1] * np.maximum(edges[1:] - 1, edges[:-1]))])


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, index of each in them)"""
    found = pa.array(hashes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _cuts(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash ranges that sorted ``hashes`` have entries in, where each range begins and ends)"""
    where = (hashes >> np.uint64(64 - int(math.log2(ranges)))).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
    cuts = np.searchsorted(where, np.arange(ranges + 1))
    return np.nonzero(np.diff(cuts))[0], cuts


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.nonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))[0]
    return hashes[first], np.add.reduceat(counts, first)


def count_ngrams(docs: DataFrame, order: int, ranges: int, text_col: str) -> DataFrame:
    """(k, part, hashes, counts, tokens, bits): the sum of the counts of the n-grams of order k in hash range ``part``
    and their filter segment; for single tokens also the sorted hashes and counts, as unsigned 64-bit numbers."""
    def rows(k: int, parts: list[np.ndarray]):
        hashes, n = np.unique(np.concatenate(parts), return_counts=True)
        some, cuts = _cuts(hashes, ranges)
        blob = [(hashes[cuts[p]:cuts[p + 1]].tobytes(), n[cuts[p]:cuts[p + 1]].astype("<u4").tobytes()) for p in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)),
             pa.array([b[0] for b in blob], pa.binary()), pa.array([b[1] for b in blob], pa.binary())],
            ["k", "part", "hashes", "counts"])

    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0
        for batch in batches:
            for some in slices(batch, 0, SLICE):
                t = tokens([x or b"" for x in some.column(0).cast(pa.binary()).to_pylist()], order)
                for k in range(order):
                    held[k].append(t.grams[k][t.place >= max(1, k)])
                    size += len(held[k][-1])
                if size >= BUFFER:
                    yield from (rows(k + 1, h) for k, h in enumerate(held))
                    held, size = [[] for _ in range(order)], 0
        if size:
            yield from (rows(k + 1, h) for k, h in enumerate(held))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["k"].iloc[0])
        hashes, counts = _summed(np.frombuffer(b"".join(part["hashes"]), "<u8"),
                                 np.frombuffer(b"".join(part["counts"]), "<u4").astype(np.int64))
        lv = level(counts)
        bits = int(LogFrequencyFilter.segment_bits(np.array([lv.sum()]))[0])
        return pd.DataFrame({
            "k": [k], "part": part["part"].iloc[:1], "hashes": [hashes.tobytes() if k == 1 else None],
            "counts": [counts.astype("<u8").tobytes() if k == 1 else None], "tokens": [int(counts.sum())],
            "bits": [LogFrequencyFilter.build_segment(hashes, lv, bits)]})

    blocks = map_arrow(docs.select(F.col(text_col)), run, "k int, part int, hashes binary, counts binary")
    return blocks.groupBy("k", "part").applyInPandas(
        merge, "k int, part int, hashes binary, counts binary, tokens bigint, bits binary")


class LogFrequencyFilter:
    """Quantised n-gram counts; segments are (order - 1) * ranges + hash range."""

    def __init__(self, ranges: int, bits: np.ndarray, segments: list[bytes] | np.ndarray, least: list[int]):
        self.ranges, self.bits = ranges, bits.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(np.uint64)
        self.filter = segments if isinstance(segments, np.ndarray) else np.frombuffer(b"".join(segments), np.uint8)
        self.value = [level_counts(m) for m in least]

    @staticmethod
    def segment_bits(inserts: np.ndarray) -> np.ndarray:
        return -(-inserts * BITS_A_KEY // 64) * 64

    @staticmethod
    def seeds(hashes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of level ``at`` start, and their step."""
        one = _mix(hashes + np.array([at], np.uint64) * _ODD[0])
        return one, _mix(one ^ _ODD[2]) | np.uint64(1)

    @staticmethod
    def bit(hashes: np.ndarray, bits) -> np.ndarray:
        """A bit number below ``bits`` (less than 2 ** 32) from the upper half of each hash."""
        return ((hashes >> np.uint64(32)) * bits) >> np.uint64(32)

    @classmethod
    def build_segment(cls, hashes: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
        """One segment, every n-gram in it once for each level up to its own."""
        held = np.zeros(bits, np.uint8)
        at = 1
        while len(hashes):
            one, two = cls.seeds(hashes, at)
            for i in range(PROBES):
                held[cls.bit(one + np.uint64(i) * two, np.uint64(bits)).astype(np.int64)] = 1
            at += 1
            hashes, levels = hashes[levels >= at], levels[levels >= at]
        return np.packbits(held, bitorder="little").tobytes()

    @classmethod
    def probe(cls, held: np.ndarray, hashes: np.ndarray, bits: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Level of each n-gram (0: not held) whose segment has ``bits`` bits from ``start`` on: levels are probed until
        one is missing."""
        out = np.zeros(len(hashes), np.int64)
        todo, at = np.nonzero(bits > 0)[0], 1
        while len(todo):
            one, two = cls.seeds(hashes[todo], at)
            for i in range(PROBES):
                bit = cls.bit(one + np.uint64(i) * two, bits[todo]) + start[todo]
                found = (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                todo, one, two = todo[found], one[found], two[found]
            out[todo] = at
            at += 1
        return out

    def levels(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram of order ``k`` (0: not held)."""
        segment = (hashes >> np.uint64(64 - int(math.log2(self.ranges)))).astype(np.int64) + (k - 1) * self.ranges
        return self.probe(self.filter, hashes, self.bits[segment], self.start[segment])

    def look_up(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, levels) of n-grams of order ``k``; each distinct one is probed once."""
        some, at = distinct(hashes)
        lv = self.levels(k, some)
        return self.value[k - 1][lv][at], lv[at]


class Vocabulary:
    """Exact counts of some tokens, found by the leading bits of their hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.lead = max(1, int(len(hashes)).bit_length() - 2)
        edges = np.arange(1 << self.lead, dtype=np.uint64) << np.uint64(64 - self.lead)
        self.first = np.searchsorted(hashes, edges).astype(np.int32)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Counts; 0 for tokens that are not held."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.hashes):
            return out
        at = self.first[(hashes >> np.uint64(64 - self.lead)).astype(np.int64)].astype(np.int64)
        todo = np.nonzero(at < len(self.hashes))[0]
        while len(todo):
            here = self.hashes[at[todo]]
            hit = here == hashes[todo]
            out[todo[hit]] = self.counts[at[todo[hit]]]
            todo = todo[here < hashes[todo]]
            at[todo] += 1
            todo = todo[at[todo] < len(self.hashes)]
        return out


class Model(NamedTuple):
    order: int
    n: int                              # training tokens
    v: int                              # distinct ones
    ranges: int                         # hash ranges of each order
    filter: LogFrequencyFilter | None   # None if it is not broadcast
    weights: np.ndarray                 # (order, context level) -> interpolation weight
    counted: DataFrame | None = None    # see count_ngrams; stays on the driver


VALUE = level_counts()



def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _state(t: Tokens, levels: list[np.ndarray]) -> np.ndarray:
    """Levels that decide the probability at each place after the mark, in one number: that of the token, and for each
    higher order those of the n-gram and of its context (0 where the text begins)."""
    out = levels[0]
    for k in range(1, len(levels)):
        before = np.where(t.place >= k, np.concatenate([levels[k - 1][:1], levels[k - 1][:-1]]), 0)
        out = ((out << STATE_BITS | levels[k]) << STATE_BITS) | before
    return out[t.place >= 1]


def _unpack(state: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(levels of the n-grams, levels of their contexts) by order; single tokens have no context."""
    levels, contexts, mask = [], [], (1 << STATE_BITS) - 1
    for _ in range(1, order):
        contexts.insert(0, state & mask)
        levels.insert(0, state >> STATE_BITS & mask)
        state = state >> 2 * STATE_BITS
    return [state, *levels], [np.zeros_like(state), *contexts]


def _width(order: int) -> int:
    """Bytes of a written state."""
    return -(-STATE_BITS * (2 * order - 1) // 8)


def _looked_up(ids: pa.Array, training: pa.Array, t: Tokens, levels: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """What is kept of some texts: n_tokens, known tokens, the sum of the logarithms of their counts, and the states."""
    scored, rows = t.place >= 1, len(t.counts)
    owner, c = t.owner[scored], counts[scored]
    width = _width(len(levels))
    packed = _state(t, levels).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    ends = (np.cumsum(t.counts) * width).tolist()
    return pa.RecordBatch.from_arrays(
        [ids, training, pa.array(t.counts), pa.array(np.bincount(owner, weights=c > 0, minlength=rows).astype(np.int64)),
         pa.array(np.bincount(owner, weights=np.log10(c + 1.0), minlength=rows)),
         pa.array([packed[a:b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary())],
        ["doc_id", "training", "n_tokens", "n_known", "logs", "states"])


def _states(batches, order: int, at: int):
    """(slice of a batch, its states in a row, states of each text); they are in column ``at``."""
    width = _width(order)
    for batch in batches:
        for some in slices(batch, at, SLICE):
            blobs = some.column(at).to_pylist()
            out = np.zeros((sum(map(len, blobs)) // width, 8), np.uint8)
            out[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
            yield some, out.view("<i8").ravel(), np.array([len(b) // width for b in blobs])


def look_up(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, logs, states) of all ``rows`` (doc_id, training, text), written."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, training boolean, n_tokens bigint, n_known bigint, logs double, states binary"
    if model.filter is None:
        return materialize(_asked(rows, model, schema), "lm-states")
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(model._replace(counted=None))
    words = sc.broadcast(_vocabulary(model))

    def run(batches):
        m, vocabulary = held.value, words.value
        for batch in batches:
            for some in slices(batch, 2, SLICE):
                t = tokens(_texts(some.column(2)), m.order)
                each = [distinct(g) for g in t.grams]
                yield _looked_up(some.column(0), some.column(1), t, [m.filter.levels(k + 1, x)[at] for k, (x, at) in enumerate(each)],
                                 vocabulary.look_up(each[0][0])[each[0][1]])

    out = materialize(map_arrow(rows, run, schema), "lm-states")
    held.destroy()
    words.destroy()
    return out


def _bundles(rows: DataFrame, order: int, ranges: int) -> DataFrame:
    """(bundle, k, part, size, doc_id, training, text, hashes): each text in a bundle (k = 0), and the distinct n-grams of order k in
    hash range ``part`` of each bundle (k > 0; size: their bytes)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["bundle", "k", "part", "size", "doc_id", "training", "text", "hashes"]

    def run(batches):
        bundle = TaskContext.get().partitionId() << 33      # the table is written: numbers of failed attempts are not in it
        for batch in batches:
            for some in slices(batch, 2, BUNDLE):
                n = some.num_rows
                zeros = pa.array(np.zeros(n, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bundle)), zeros, zeros, zeros.cast(pa.int64()),
                                                  *some.columns, pa.nulls(n, pa.binary())], names)
                t = tokens(_texts(some.column(2)), order)
                for k in range(order):
                    hashes = np.unique(t.grams[k][t.place >= k])
                    parts, cuts = _cuts(hashes, ranges)
                    blobs = [hashes[cuts[p]:cuts[p + 1]].tobytes() for p in parts]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, bundle)), pa.array(np.full(n, k + 1, np.int32)), pa.array(parts.astype(np.int32)),
                         pa.array([len(x) for x in blobs], pa.int64()), *[pa.nulls(n, c.type) for c in some.columns],
                         pa.array(blobs, pa.binary())], names)
                bundle += 1

    return materialize(map_arrow(rows, run, f"bundle bigint, k int, part int, size bigint, doc_id {kind}, "
                                 "training boolean, text string, hashes binary"), "lm-bundles")


def _answers(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(bundle, k, part, levels, counts) of the n-grams that bundles ask for: their levels (a byte each), from the segment of
    their hash range, and for single tokens their exact counts (unsigned 64-bit). Many askers of one range are divided,
    each division with a copy of the segment."""
    most = asked.groupBy("k", "part").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
    salts = -(-most // ASKED_BYTES) or 1

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        blobs = asked.column("hashes").to_pylist()
        hashes, at = distinct(np.frombuffer(b"".join(blobs), "<u8"))
        levels, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.uint64)
        if held.num_rows:
            bits = np.frombuffer(held.column("bits")[0].as_py(), np.uint8)
            levels = LogFrequencyFilter.probe(bits, hashes, np.full(len(hashes), 8 * len(bits), np.uint64),
                                              np.zeros(len(hashes), np.uint64))
            if held.column("hashes")[0].is_valid and len(bits):
                known = np.frombuffer(held.column("hashes")[0].as_py(), "<u8")
                here = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                counts = np.where(known[here] == hashes, np.frombuffer(held.column("counts")[0].as_py(), "<u8")[here], 0)
        levels, counts = levels.astype(np.uint8)[at], counts.astype("<u8")[at]
        ends = np.cumsum([len(b) // 8 for b in blobs]).tolist()
        cuts = list(zip([0, *ends[:-1]], ends))
        exact = held.num_rows and held.column("hashes")[0].is_valid
        return pa.table({
            "bundle": asked.column("bundle"), "k": asked.column("k"), "part": asked.column("part"),
            "levels": pa.array([levels[a:b].tobytes() for a, b in cuts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() if exact else None for a, b in cuts], pa.binary())})

    keys = ["k", "part", "salt"]
    asked = asked.select("k", "part", F.pmod(F.xxhash64("bundle"), F.lit(salts)).cast("int").alias("salt"), "bundle", "hashes")
    held = counted.select("k", "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "hashes", "counts", "bits")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        answer, "bundle bigint, k int, part int, levels binary, counts binary")


def _asked(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """What is kept of all ``rows``, with levels and counts that the hash ranges answer."""
    n_orders = model.order
    bundles = _bundles(rows, n_orders, model.ranges)

    def one(texts: pa.Table, told: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        t = tokens(_texts(texts.column("text")), n_orders)
        told = told.sort_by([("k", "ascending"), ("part", "ascending")])
        order, blobs, exact = (told.column(x).to_pylist() for x in ("k", "levels", "counts"))
        levels, counts = [], np.zeros(len(t.place), np.int64)
        for k in range(n_orders):
            use = t.place >= k
            at = np.unique(t.grams[k][use], return_inverse=True)[1]
            out = np.zeros(len(t.place), np.int64)
            out[use] = np.frombuffer(b"".join(x for o, x in zip(order, blobs) if o == k + 1), np.uint8)[at]
            levels.append(out)
            if k == 0:      # a range that counted nothing tells no counts
                c = b"".join(bytes(8 * len(x)) if y is None else y for o, x, y in zip(order, blobs, exact) if o == 1)
                counts = np.frombuffer(c, "<u8").astype(np.int64)[at]
        ids, training = (texts.column(x).combine_chunks() for x in ("doc_id", "training"))
        return pa.Table.from_batches([_looked_up(ids, training, t, levels, counts)])

    answers = _answers(bundles.where("k > 0").select("bundle", "k", "part", "size", "hashes"), model.counted)
    texts = bundles.where("k = 0").select("bundle", "doc_id", "training", "text")
    return texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(one, schema)


def _ml(above: np.ndarray, before: np.ndarray, less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(P_ml, level of the context) of n-grams of level ``above`` in contexts of level ``before``; ``less`` is taken off
    both counts."""
    counts = np.maximum(VALUE[before] - less, 0)
    p = np.where(counts > 0, np.minimum(np.maximum(VALUE[above] - less, 0) / np.maximum(counts, 1e-9), 1.0), 0.0)
    return p, np.where(counts > 0, np.minimum(before, 63), 0)


def probabilities(model: Model, state: np.ndarray) -> np.ndarray:
    """Smoothed probability in each state."""
    levels, contexts = _unpack(state, model.order)
    p = (VALUE[levels[0]] + 1) / (model.n + model.v + 1)
    for k in range(1, model.order):
        ml, context = _ml(levels[k], contexts[k])
        a = model.weights[k][context]         # 0 at level 0
        p = a * ml + (1 - a) * p
    return p


def _tune(rows: DataFrame, model: Model) -> np.ndarray:
    """Interpolation weights by deleted interpolation from ``rows`` (states): the sums of log-likelihood for each candidate
    are added up over the documents; a context level that was not met keeps the weight of the level below."""
    weights = np.zeros((model.order, 64))
    m = model._replace(counted=None, filter=None)

    def run(batches):
        sums = np.zeros((m.order - 1, 64, len(WEIGHTS)))
        for _, state, _ in _states(batches, m.order, 0):
            state, at = distinct(state)
            many = np.bincount(at, minlength=len(state))
            levels, contexts = _unpack(state, m.order)
            p = np.maximum(VALUE[levels[0]], 1) / (m.n + m.v + 1)
            for k in range(1, m.order):
                ml, context = _ml(levels[k], contexts[k], 1.0)
                use = np.nonzero(context)[0]
                gain = np.log(p[use, None] + WEIGHTS * (ml[use] - p[use])[:, None]) * many[use, None]
                np.add.at(sums[k - 1], context[use], gain)
                p = np.where(context > 0, 0.5 * ml + 0.5 * p, p)     # lower orders as seen by the next one
        k, lv, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(lv), pa.array(j), pa.array(sums[k, lv, j])],
                                         ["k", "lv", "j", "gain"])

    rows = map_arrow(rows.select("states"), run, "k bigint, lv bigint, j bigint, gain double").groupBy(
        "k", "lv", "j").agg(F.sum("gain").alias("gain")).collect()      # at most orders x 64 x 20 numbers
    sums = np.full((model.order - 1, 64, len(WEIGHTS)), 0.0)
    for r in rows:
        sums[r["k"], r["lv"], r["j"]] = r["gain"]
    for k in range(model.order - 1):
        last = 0.0
        for lv in range(1, 64):
            if sums[k, lv].any():
                last = WEIGHTS[sums[k, lv].argmax()]
            weights[k + 1, lv] = last
    return weights


def _count(docs: DataFrame, order: int, text_col: str) -> Model:
    """The model of the documents but for its weights."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = 1 << max(6, math.ceil(math.log2(max(1.0, size / 6 / RANGE_TOKENS))))
    counted = materialize(count_ngrams(docs, order, ranges, text_col), "lm-counts")

    first = counted.where("k = 1").agg(F.sum("tokens"), F.sum(F.octet_length("hashes"))).first()
    n, v = first[0] or 0, (first[1] or 0) // 8

    size = counted.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    small = size <= MAX_FILTER_BYTES and v <= MAX_VOCABULARY
    return Model(order, n, v, ranges, _filter(counted, ranges, order) if small else None, np.zeros((order, 64)), counted)


def learn(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the documents."""
    model = _count(docs, order, text_col)
    return model._replace(weights=_tune(look_up(_rows(docs, F.lit(True), id_col, text_col), model), model))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    return _scored(look_up(_rows(docs, F.lit(False), id_col, text_col), model), model)


def learn_and_score(docs: DataFrame, training: Column, order: int = ORDER, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model of the rows for which ``training`` holds, scores of all rows): as by :func:`learn` and :func:`score`, but
    each text is looked up once."""
    model = _count(docs.where(training), order, text_col)
    rows = look_up(_rows(docs, F.coalesce(training, F.lit(False)), id_col, text_col), model)
    model = model._replace(weights=_tune(rows.where("training"), model))
    return model, _scored(rows, model)


def _filter(counted: DataFrame, ranges: int, order: int) -> LogFrequencyFilter:
    """The whole filter, of at most MAX_FILTER_BYTES, its segments put in place one by one."""
    sizes = np.zeros(order * ranges, np.int64)
    for r in counted.select("k", "part", F.octet_length("bits").alias("size")).collect():     # orders x ranges numbers
        sizes[(r["k"] - 1) * ranges + r["part"]] = r["size"]
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(int(sizes.sum()), np.uint8)
    for r in counted.select("k", "part", "bits").toLocalIterator():
        at = starts[(r["k"] - 1) * ranges + r["part"]]
        held[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return LogFrequencyFilter(ranges, 8 * sizes, held, [1] * order)


def _vocabulary(model: Model) -> Vocabulary:
    """The exact counts of all tokens, at most MAX_VOCABULARY."""
    hashes, counts, at = np.empty(model.v, np.uint64), np.empty(model.v, np.uint32 if model.n < 1 << 32 else np.int64), 0
    for r in model.counted.where("k = 1").select("part", "hashes", "counts").orderBy("part").toLocalIterator():
        some = np.frombuffer(r["hashes"], "<u8")
        hashes[at:at + len(some)] = some
        counts[at:at + len(some)] = np.frombuffer(r["counts"], "<u8")
        at += len(some)
    return Vocabulary(hashes, counts)


def _rows(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), training.alias("training"), F.col(text_col).alias("text"))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Scores from what was looked up."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    m = model._replace(counted=None, filter=None)

    def run(batches):
        for some, state, counts in _states(batches, m.order, 4):
            state, at = distinct(state)
            logs = np.log10(probabilities(m, state))[at]
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=logs, minlength=len(counts))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(total)], ["doc_id", "n_tokens", "n_known", "logs", "score"])

    out = map_arrow(rows.select("doc_id", "n_tokens", "n_known", "logs", "states"), run,
                    f"doc_id {kind}, n_tokens bigint, n_known bigint, logs double, score double")
    unit = math.log10(model.n + model.v + 1)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                      (F.col("logs") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")


def held_out(id_col: str = "doc_id") -> Column:
    """A seventh of the documents, by id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))
