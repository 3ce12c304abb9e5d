"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints of ``max_bits`` or fewer differing bits are linked. The 64 bit
positions are dealt into ``m`` groups, strongly correlated bits together; group i
gets a threshold t_i >= -1 with sum(t_i) = max_bits - m + 1. If two fingerprints
differ in at most ``max_bits`` places, some group differs in at most t_i, so probing
every group within its own threshold misses no link. The thresholds are chosen by
dynamic programming over the candidates that each (group, threshold) would bring,
estimated from the value counts of all fingerprints.

Everything runs over *distinct* fingerprints, so exact copies cost one row. A
fingerprint whose probes would meet more than ``MEET_ABOVE`` others (it lies in a dense
heap of near copies) is not probed; such fingerprints are matched among themselves by
meeting half way: with max_bits = 2, x and y are within 2 bits if and only if some value is
within 1 bit of both. A value is met by at most 65 fingerprints, so that part is linear
whatever the heap. Links between a probed fingerprint and any other are found by the
probe, so no link is lost and no group is capped.

Defined cases: null text and text without words have fingerprint 0; repeated doc_ids and
rows share a class; a null doc_id is kept with its class's least non-null id (null if there is none).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, map_arrow, materialize, quoted
from .components import connected_components

MEET_ABOVE = 256      # candidates of one fingerprint from which matching half way is cheaper
GROUPINGS = (2, 3)    # numbers of bit groups that are tried
_BLOCK = 1 << 17      # shingles handled at once


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ASCII-lower-cased words' shingles (repeats counted)."""
    words = text.lower().split() if text else []   # bytes.split(): exactly \x20 and \x09-\x0D
    if not words:
        return 0
    buf = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    last = end[min(shingle, len(words)) - 1:]
    start = start[:len(last)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), _BLOCK):
        pairs = zip(start[at:at + _BLOCK].tolist(), last[at:at + _BLOCK].tolist())
        h = np.array([digest(buf[x:y], seed) for x, y in pairs], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits = np.concatenate([bits, np.zeros((-len(bits) % 255, 64), np.uint8)])
        ones += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, fp bigint")


def bit_correlations(nodes: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the fingerprint bits, from counts over all ``nodes``."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(fps)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i * 64 + j, -1)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["cell", "n"])

    sums = map_arrow(nodes.select("fp"), run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = {r["cell"]: r["n"] for r in sums.collect()}   # at most 2,081 numbers
    n = max(1, cells.pop(-1, 0))
    both = np.zeros((64, 64))
    for cell, k in cells.items():
        both[cell // 64, cell % 64] = both[cell % 64, cell // 64] = k / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` bit groups of near-equal width; each grows by the bit most correlated with it."""
    left, groups = set(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        seed = max(sorted(left), key=lambda b: sum(corr[b, x] for x in left if x != b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: sum(corr[b, x] for x in group))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], max_bits: int) -> list[int]:
    """Thresholds t_i in -1..max_bits with sum max_bits - m + 1 of least total cost.

    ``costs[i][t + 1]`` is the cost of probing group i within t bits. Dynamic
    programming over groups and the sum handed out so far.
    """
    best = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (got, (cost, chosen)), t in itertools.product(best.items(), range(-1, max_bits + 1)):
            now = (cost + options[t + 1], chosen + [t])
            if got + t not in step or now < step[got + t]:
                step[got + t] = now
        best = step
    return best[max_bits - len(costs) + 1][1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _flips(bits: list[int], radius: int) -> list[int]:
    """Masks that flip up to ``radius`` of ``bits``, as signed longs."""
    return [_signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in itertools.combinations(bits, k)]


def _plan(nodes: DataFrame, groups: list[list[int]], max_bits: int):
    """(groups, masks, index, counts, thresholds, cost a fingerprint) of one grouping, from the counts of its values."""
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(k)).alias("key"))
                     for i, k in enumerate(masks)])
    index = nodes.select("fp", F.inline(keys))
    counts = materialize(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "simhash-counts")
    # what a probe of part i meets on average, over values that are probed at all
    small = F.col("n") <= MEET_ABOVE
    stat = {r["part"]: r for r in counts.groupBy("part").agg(
        F.sum(F.when(small, F.col("n") * F.col("n")).otherwise(0)).alias("pairs"),
        F.sum(F.col("n")).alias("all")).collect()}
    costs = []
    for i, bits in enumerate(groups):
        met = float(stat[i]["pairs"]) / max(1, stat[i]["all"]) if i in stat else 0.0
        costs.append([0.0] + [len(_flips(bits, t)) * (1.0 + met) for t in range(max_bits + 1)])
    chosen = allocate(costs, max_bits)
    return groups, masks, index, counts, chosen, sum(c[t + 1] for c, t in zip(costs, chosen))


def links(nodes: DataFrame, max_bits: int = 2, groupings: tuple[int, ...] = GROUPINGS) -> DataFrame:
    """(a, b) links between distinct fingerprints ``nodes.fp``: all those within ``max_bits``
    where one side is probed, and for the others enough to join everything within ``max_bits``. Of the ``groupings``
    (numbers of bit groups) the one whose counted probes and candidates cost least is used."""
    if max_bits != 2:
        raise ValueError("matching half way is written for max_bits = 2")
    corr = bit_correlations(nodes)
    plans = [_plan(nodes, group_bits(corr, m), max_bits) for m in groupings]
    groups, masks, index, counts, chosen, _ = min(plans, key=lambda p: p[-1])
    small = F.col("n") <= MEET_ABOVE

    probes = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(masks[i])).bitwiseXOR(F.lit(flip)).alias("key"))
        for i, t in enumerate(chosen) if t >= 0 for flip in _flips(groups[i], t)])
    probed = materialize(nodes.select("fp", F.inline(probes)).join(counts, ["part", "key"]), "simhash-probes")
    dense = probed.groupBy("fp").agg(F.sum("n").alias("met")).where(F.col("met") > MEET_ABOVE).select("fp")
    dense = materialize(dense, "simhash-dense")

    # probe and verify: a value above MEET_ABOVE is met by no probed fingerprint
    asked = probed.join(dense, "fp", "left_anti").select("part", "key", F.col("fp").alias("a"))
    held = index.join(counts.where(small).select("part", "key"), ["part", "key"], "left_semi").select(
        "part", "key", F.col("fp").alias("b"))
    found = asked.join(held, ["part", "key"]).where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")

    # meeting half way, for dense fingerprints: at most 65 meet at one value
    half = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in _flips(list(range(64)), 1)[1:]])
    met = dense.select(F.explode(half).alias("value"), "fp").groupBy("value").agg(F.collect_list("fp").alias("fps"))
    met = met.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b")
    return found.unionByName(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of ``docs``: the class is named by its least doc_id."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    classes = connected_components(links(nodes, max_bits), "a", "b").withColumnRenamed("node", "fp")
    named = nodes.join(classes, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each class of ``docs``: that with the least id (of rows that repeat it, the one with the
    least text). Rows with a null id can't be told apart and all stay."""
    own, nth = free_names(docs, "__id", "__n")
    this = quoted(id_col)
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits).where(F.col("doc_id").isNotNull())
    named = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    named = materialize(named.where("n > 1 or not first"), "simhash-extra").select(F.col("doc_id").alias(own), "n", "first")
    gone, again = named.where("not first").select(own), named.where("first").select(own)
    left = docs.join(gone, this == F.col(own), "left_anti")
    if again.isEmpty():
        return left
    rest = left.join(again, this == F.col(own), "left_anti")
    one = left.join(again, this == F.col(own), "left_semi").withColumn(
        nth, F.row_number().over(Window.partitionBy(this).orderBy(quoted(text_col)))).where(F.col(nth) == 1).drop(nth)
    return rest.unionByName(one)
