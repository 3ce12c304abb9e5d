import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mintlens.llm import language_id as L

from .corpus import DOCS, frame, lines, rows


def data(n=240):
    rng = random.Random(12)
    out = []
    for k in range(n):
        lang = ["en", "de", "fr"][k % 3]
        out.append((k, lines(rng, rng.randint(1, 8), lang), lang if k % 11 else None))
    return out


def test_gradients_match_differences():
    net = L.Network(["a", "b", "c"], hidden=3, seed=1)
    for d in (net.forward, net.backward):
        d.params = {k: v.astype(np.float64) for k, v in d.params.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (7, 4))
    x[5:, 1] = L.PAD
    live = (x != L.PAD).astype(np.float64)[:, None, :]
    goal = rng.standard_normal((7, 3, 4))

    def loss():
        return float((net.forward.states(x, live) * goal).sum())

    kept = []
    net.forward.states(x, live, kept)
    grad = net.forward.gradients(x, live, kept, goal)
    for name, at in (("u", (1, 2)), ("u", (4, 0)), ("u", (8, 1)), ("w", (0, 99)), ("w", (5, 100)), ("w", (7, 101))):
        p = net.forward.params[name]
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-3)


def test_held_out_accuracy(spark):
    rows_ = data()
    docs = frame(spark, rows_, clash=True)
    net = L.train(docs, ~L.held_out())
    truth = {k: ["en", "de", "fr"][k % 3] for k, _, _ in rows_}
    out = L.predict(docs, net).join(docs.select("doc_id", L.held_out().alias("h")), "doc_id").collect()
    held = [r for r in out if r.h]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_padding_and_batches_do_not_matter():
    net = L.Network(["a", "b"], seed=3)
    texts = [b"x", b"hello world", b"", b"y" * L.SEGMENT, b"z" * (3 * L.SEGMENT + 5)]
    together = net.pool(texts)
    alone = np.concatenate([net.pool([t]) for t in texts if t])
    assert np.allclose(together[[0, 1, 3, 4]], alone, atol=1e-5) and not together[2].any()
    assert np.allclose(together[[0, 1, 3, 4]].sum(axis=1), 1, atol=1e-5)


def test_awkward_rows_and_rejection(spark):
    docs = frame(spark)
    net = L.train(docs, ~L.held_out())
    got = {(r.doc_id): r for r in L.predict(docs, net).collect()}
    for k in (100, 101, 102, 103):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[104].lang_pred != "und" and len(L.predict(docs, net).collect()) == len(rows())
    kept = L.keep_identified(docs, net)
    assert kept.columns == docs.columns and not {100, 101, 102, 103} & {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 106, None}


def test_no_labels_and_empty_table(spark):
    docs = frame(spark, [(1, "a text", None), (2, "another", None)])
    net = L.train(docs, ~L.held_out())
    assert net is None and {r.lang_pred for r in L.predict(docs, net).collect()} == {"und"}
    assert L.predict(spark.createDataFrame([], DOCS), None).collect() == []


def test_every_labelled_language_is_learned(spark, monkeypatch):
    """However many there are; one id may stand for many rows without widening the sample."""
    monkeypatch.setattr(L, "EPOCHS", 1)
    monkeypatch.setattr(L, "DOCS_A_LANG", 2)
    seen = []
    monkeypatch.setattr(L.Network, "train", lambda self, x, y, **_: seen.append((len(x), len(set(y.tolist())))))
    data_ = [(k % 2, f"text number {k} of language", f"l{k % 70}") for k in range(700)]
    net = L.train(frame(spark, data_, clash=True), F.lit(True))
    assert len(net.langs) == 70 and seen == [(140, 70)]


def plain_probabilities(net, text):
    """One position after the other, straight from the gates' definitions."""
    def states(d, order):
        h, w, u = d.h, d.params["w"].astype(float), d.params["u"].astype(float)
        s, out = np.zeros(h), {}
        for t in order:
            a = w[:, text[t]]
            z = 1 / (1 + np.exp(-(a[:h] + u[:h] @ s)))
            r = 1 / (1 + np.exp(-(a[h:2 * h] + u[h:2 * h] @ s)))
            n = np.tanh(a[2 * h:] + r * (u[2 * h:] @ s))
            s = out[t] = z * s + (1 - z) * n
        return out
    total = 0
    for lo in range(0, len(text), L.SEGMENT):
        places = range(lo, min(lo + L.SEGMENT, len(text)))
        ahead, behind = states(net.forward, places), states(net.backward, reversed(places))
        for t in places:
            e = np.exp(net.out["v"].astype(float) @ np.concatenate([ahead[t], behind[t]]) + net.out["b"][:, 0])
            total = total + e / e.sum()
    return total / len(text)


def test_pooled_probabilities_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    net = L.Network(["a", "b", "c"], seed=5)
    texts = [bytes(rng.integers(1, 256, n).tolist()) for n in (1, 7, L.SEGMENT, L.SEGMENT + 1, 250)]
    assert np.allclose(net.pool(texts), [plain_probabilities(net, t) for t in texts], atol=1e-4)
