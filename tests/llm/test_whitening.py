import random

import numpy as np
import pytest
from pyspark.sql import types as T

from mintlens.llm import whitening as W

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("w", T.StringType()), T.StructField("n", T.StringType()),
                     T.StructField("deviation", T.StringType()), T.StructField("component", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", "x", "x", "x") for k, v in rows], VECS)


def vectors(n=90, dims=11, seed=2):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) * 0.2 + rng.standard_normal(dims)
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(mixed)]


def plain(rows, components=8):
    """Straight from the definitions, with exact integers."""
    x = np.array([[int(np.floor(c * 1024)) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(v, s))) for v in x]
    off = np.array([[float(n * a - b) / n for a, b in zip(v, s)] for v in x])
    cov = off.T @ off / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, dev, off @ u / np.sqrt(e), e / np.trace(cov)


def test_equals_plain_whitening(spark):
    rows = vectors()
    bad = [(500, None), (501, [1.0] * 10 + [None]), (502, [float("nan")] + [0.0] * 10), (503, [float("inf")] + [0.0] * 10),
           (504, [1.0, 2.0]), (505, [])]
    repeated = [(3, rows[3][1]), (None, rows[5][1])]
    n, dev, w, explained = plain(rows + repeated)
    out = W.whiten(frame(spark, rows + bad + repeated).repartition(5)).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {c: np.sign(by[0, c][0].whitened * w[0, c - 1]) for c in range(1, 9)}
    for at, (k, _) in enumerate(rows + repeated):
        for c in range(1, 9):
            found = by[k, c]
            assert len(found) == 1 + (k == 3)
            assert found[0].deviation == dev[at]
            assert found[0].whitened * signs[c] == pytest.approx(w[at, c - 1], rel=1e-9, abs=1e-9)
            assert found[0].explained == pytest.approx(explained[c - 1], rel=1e-10)
            assert found[0].identity_error < 1e-9


def test_polarisation_is_exact_whatever_the_size():
    rng = random.Random(4)
    for most in (5, 10 ** 5, 1 << 30, 1 << 52):
        y = np.array([[rng.randint(-most, most) for _ in range(4)] for _ in range(30)], np.int64)
        total, left = W.squares(y), [int(v) for v in y.astype(object).sum(axis=0)]
        cov = W.covariance(30, left, total)
        for i in range(4):
            for j in range(4):
                a, b = [int(v) for v in y[:, i]], [int(v) for v in y[:, j]]
                exact = 30 * sum(p * q for p, q in zip(a, b)) - sum(a) * sum(b)
                assert cov[i, j] == exact / 900


def test_no_variance_and_few_dimensions(spark):
    out = W.whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 3.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in out) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for r in out:
        assert r.deviation == 1024 ** 2 and r.identity_error < 1e-12
        assert (abs(r.whitened) == pytest.approx(1.0) and r.explained == 1.0) if r.component == 1 else r.whitened is None
    same = W.whiten(frame(spark, [(1, [0.5]), (2, [0.5])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(None, None, None, 0)] * 2


def test_huge_entries_saturate(spark):
    out = W.whiten(frame(spark, [(k, [3e38 * (-1) ** k, float(k)]) for k in range(6)])).collect()
    assert len(out) == 12 and all(r.deviation is None for r in out)
    assert all(abs(r.whitened) == pytest.approx(1.0) for r in out if r.component == 1)


def test_empty(spark):
    for rows in ([], [(1, None), (2, [])]):
        out = W.whiten(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0
