import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from mintlens.llm import sharding as S
from mintlens.llm.common import scratch_path

from .corpus import DOCS, clashing, frame, own_columns, rows, words


def test_contract_of_a_packing(spark):
    data = rows()
    got = S.assign(frame(spark, clash=True), shards=7).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in data), key=str)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 7
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_balance_groups_and_a_hot_text(spark):
    rng = random.Random(1)
    data = [(k, words(rng, rng.randint(1, 60)), "en") for k in range(3000)]
    data += [(10_000 + k, "one text that makes up a third of all rows", "en") for k in range(1500)]
    data += [(20_000 + k, data[k // 3][1], "en") for k in range(300)]
    got = S.assign(frame(spark, data), shards=10).collect()
    size, rows_in, where = Counter(), Counter(), defaultdict(Counter)
    text = {i: t for i, t, _ in data}
    for r in got:
        size[r.shard] += r["size"]
        rows_in[r.shard] += 1
        where[text[r.doc_id]][r.shard] += 1
    assert max(size.values()) < 1.01 * min(size.values())
    assert max(rows_in.values()) < 1.2 * min(rows_in.values())
    hot = where.pop("one text that makes up a third of all rows")
    assert len(hot) > 5                                   # the hot text is spread
    assert all(len(w) == 1 for w in where.values())       # groups that fit are not


def test_cells_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPS_A_CELL", 100)
    rng = random.Random(2)
    data = [(k, words(rng, rng.randint(1, 40)), "en") for k in range(1200)]
    got = S.assign(frame(spark, data), shards=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 1200
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.06 * min(size.values())


def test_placing_follows_the_residual_capacity():
    v = np.array([[6.0, 0], [6, 0], [0, 5], [0, 5], [1, 1], [1, 1]])
    out = S.place(v, 2, weights=(1.0, 1.0))
    assert out[0] != out[1] and out[2] != out[3] and out[4] != out[5]


def test_same_result_again(spark):
    a, b = (sorted(map(tuple, S.assign(frame(spark).repartition(n), 5).collect()), key=str) for n in (2, 7))
    assert a == b


def test_empty_table(spark):
    assert S.assign(spark.createDataFrame([], DOCS)).collect() == []


def test_written_shards_hold_every_row_once(spark):
    docs = clashing(frame(spark)).withColumn("shard", F.lit("mine"))
    out = scratch_path(spark, "test-shards")
    name = S.write_shards(docs, out, shards=5)
    assert name == "_shard"
    back = spark.read.parquet(out)
    assert sorted(back.columns) == sorted([*docs.columns, name])
    got = back.collect()
    own_columns(got)
    assert sorted(((r.doc_id, r.text, r.lang) for r in got), key=str) == sorted(rows(), key=str)
    assert {r[name] for r in got} <= set(range(5)) and {r["shard"] for r in got} == {"mine"}


def plain_packing(units, shards, first, weights):
    """Greedy packing one group at a time: [(bytes, tokens, rows)] -> shards."""
    totals = [sum(u[d] for u in units) or 1e-12 for d in range(3)]
    vectors = [[u[d] / totals[d] * shards for d in range(3)] for u in units]
    left = [[1.0] * 3 for _ in range(shards)]
    out = {}
    for k in sorted(range(len(units)), key=lambda k: (-max(vectors[k]), -sum(vectors[k]), k)):
        gain = [sum(r * w * x for r, w, x in zip(room, weights, vectors[k])) for room in left]
        s = gain.index(max(gain))
        left[s] = [r - x for r, x in zip(left[s], vectors[k])]
        out[k] = (s + first) % shards
    return [out[k] for k in range(len(units))]


def test_placing_equals_plain_packing():
    rng = random.Random(4)
    for weights in (S.WEIGHTS, (1.0, 1.0, 1.0)):
        for shards in (1, 3, 8):
            units = [(rng.randint(16, 5000), rng.randint(0, 900), rng.choice([1, 1, 1, 2, 5])) for _ in range(200)]
            got = S.place(np.array(units, float), shards, 2 % shards, weights)
            assert got.tolist() == plain_packing(units, shards, 2 % shards, weights)


def test_assignment_equals_plain_packing(spark):
    rng = random.Random(6)
    data = [(k, words(rng, rng.randint(1, 60)), "en") for k in range(400)]
    data += [(1000 + k, data[k][1], "en") for k in range(50)]                       # one cell; no group is divided
    got = {r.doc_id: r for r in S.assign(frame(spark, data), shards=3).collect()}
    text = {i: t for i, t, _ in data}
    groups = defaultdict(list)
    for i, t in text.items():
        groups[t].append(i)
    keys = {r.t: r.g for r in frame(spark, data).selectExpr("text as t", "xxhash64(text) as g").collect()}
    order = sorted(groups, key=lambda t: (keys[t], len(t.encode()) + S.ROW_BYTES))
    units = [(len(groups[t]) * (len(t.encode()) + S.ROW_BYTES), len(groups[t]) * len(t.split()), len(groups[t])) for t in order]
    want = plain_packing(units, 3, 0, S.WEIGHTS)
    assert {i: got[i].shard for i in text} == {i: s for t, s in zip(order, want) for i in groups[t]}
