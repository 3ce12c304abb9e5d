import numpy as np
import pytest
import xxhash

from mintlens.llm import simhash_dedup as S
from mintlens.llm.components import connected_components

from .corpus import DOCS, clashing, frame, own_columns, rows


def plain_fingerprint(text):
    w = [x for x in (text or "").translate({k: k + 32 for k in range(65, 91)}).replace("\t", " ").replace("\n", " ")
         .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps, max_bits=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def test_matches_brute_force(spark):
    data = rows()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(frame(spark, clash=True)).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in data]
    of = plain_classes(fps)
    for (i, _, _), fp, c in zip(data, fps, of):
        ids = [data[k][0] for k in range(len(data)) if of[k] == c and data[k][0] is not None]
        assert got[(i, f"{fp:016x}")] == (min(ids) if ids else None)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c') x").first().x
    assert got % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert S.keep_one(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("meet_above,groupings", [(1, (2, 3)), (8, (3,)), (8, (2,)), (256, (3,)), (256, (2,))])
def test_dense_heap_loses_no_link(spark, monkeypatch, meet_above, groupings):
    """A heap of near copies (all in one ball) and scattered ones, whichever way each is matched, with either number of groups."""
    monkeypatch.setattr(S, "MEET_ABOVE", meet_above)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    heap = {centre}
    while len(heap) < 150:
        x = centre
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        heap.add(x)
    heap |= {int(x) for x in rng.integers(0, 2**63, 100)}
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(heap)]
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), groupings=groupings)
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    of = plain_classes([x % 2**64 for x in signed])
    same = {}
    for x, c in zip(signed, of):
        same.setdefault(c, []).append(x)
    for members in same.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_thresholds_are_the_cheapest():
    costs = [[0, 5, 9, 20], [0, 100, 300, 900], [0, 6, 10, 22]]
    assert S.allocate(costs, 2) == [0, -1, 1] or sum(c[t + 1] for c, t in zip(costs, S.allocate(costs, 2))) == 15
    assert sum(S.allocate(costs, 2)) == 0
    assert S.allocate([[0, 1, 2, 3], [0, 1, 50, 60]], 2) == [1, 0]


def test_correlated_bits_share_a_group():
    corr = np.eye(64)
    for a, b in ((3, 40), (3, 41), (40, 41)):
        corr[a, b] = corr[b, a] = 0.9
    groups = S.group_bits(corr, 3)
    assert sorted(sum(groups, [])) == list(range(64))
    assert any({3, 40, 41} <= set(g) for g in groups)


def test_keep_one_of_each_class(spark):
    docs = frame(spark)
    kept = S.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept[0].asDict().keys() == docs.first().asDict().keys()
    named = {r.component_id for r in S.near_duplicates(docs).collect() if r.doc_id is not None}
    assert named - {None} == set(ids)


def test_keep_one_leaves_columns_named_like_the_helpers(spark):
    docs = clashing(frame(spark))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    own_columns(rows)
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(
        ((r.doc_id, r.text) for r in S.keep_one(frame(spark)).collect()), key=str)


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000), (500, 400), (400, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[k] for k in range(301)} == {0} and got[500] == got[400] == 400 and 1000 not in got
