import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mintlens.llm import lm_scoring as L

from .corpus import DOCS, frame, rows


def toks(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def plain(data):
    c = Counter(w for i, t, _ in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)))
            for i, t, _ in data]


def run(docs, order=2):
    return L.learn_and_score(docs, ~L.held_out(), order)[1].collect()


@pytest.mark.parametrize("most", [8 << 20, 40])
def test_base_score_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(L, "MAX_VOCABULARY", most)      # with 40 the hash ranges answer
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in run(frame(spark, clash=True))), key=str)
    for a, b in zip(got, sorted(plain(rows()), key=str), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    follows = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(60)}
    data = []
    for i in range(300):
        w = ["w0"]
        while len(w) < 60:
            w.append(rng.choice(follows[w[-1]]))
        data.append((i, " ".join(w), "en"))
    for order in (2, 3):
        out = run(frame(spark, data), order)
        held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        assert sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)
        assert all(r.score < 0 for r in out)


def test_filter_gives_quantised_counts_back():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.geometric(0.2, len(hashes))
    lv = L.level(counts)
    ranges, part = 4, (hashes >> np.uint64(62)).astype(int)
    bits = [int(L.LogFrequencyFilter.segment_bits(np.array([lv[part == p].sum()]))[0]) for p in range(ranges)]
    f = L.LogFrequencyFilter(ranges, np.array(bits), [L.LogFrequencyFilter.build_segment(hashes[part == p], lv[part == p], bits[p])
                                                      for p in range(ranges)], [1])
    got = f.levels(1, hashes)
    assert (got >= lv).all() and (got == lv).mean() > 0.95        # never too low
    assert (f.levels(1, rng.integers(0, 2**64, 5000, dtype=np.uint64)) > 0).mean() < 0.03
    value = f.value[0][lv]
    assert (value <= 1.5 * counts).all() and (value >= counts / 1.5).all()


def test_broadcast_filter_is_bounded(spark, monkeypatch):
    assert len(L.learn(frame(spark)).filter.filter) > 2000
    monkeypatch.setattr(L, "MAX_FILTER_BYTES", 2000)
    assert L.learn(frame(spark)).filter is None


def test_grams_stay_inside_a_text():
    t = L.tokens([b"a b", b"", b"A"], 3)
    assert t.counts.tolist() == [3, 1, 2] and t.place.tolist() == [0, 1, 2, 3, 0, 1, 0, 1, 2]
    assert t.grams[1][1] == t.grams[1][7]                          # mark + a
    assert len(set(t.grams[2][t.place >= 2].tolist())) == 3


def test_empty_and_unlearned(spark):
    assert run(spark.createDataFrame([], DOCS)) == []
    held = [(i, t, "en") for i, t, _ in rows() if i is not None and zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in run(frame(spark, held)))


def test_every_ngram_is_kept_and_answers_of_ranges_equal_the_broadcast_filter(spark, monkeypatch):
    for order in (2, 3):
        data = rows() + [(None, "no id here at all", "en")]
        whole = L.learn(frame(spark, data), order)
        t = L.tokens([(x or "").encode() for _, x, _ in data], order)
        for k in range(1, order + 1):
            assert (whole.filter.look_up(k, t.grams[k - 1][t.place >= max(1, k - 1)])[1] > 0).all()      # those seen once too
        want = sorted(map(tuple, run(frame(spark, data), order)), key=str)
        with monkeypatch.context() as m:
            m.setattr(L, "MAX_FILTER_BYTES", 20_000)
            m.setattr(L, "ASKED_BYTES", 200)          # several divisions of a hash range
            model = L.learn(frame(spark, data), order)
            assert model.filter is None
            np.testing.assert_allclose(model.weights, whole.weights)
            got = sorted(map(tuple, run(frame(spark, data, clash=True), order)), key=str)
            assert run(spark.createDataFrame([], DOCS), order) == []
        assert [r[:4] for r in got] == [r[:4] for r in want]
        np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def test_ranges_answer_with_nothing_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_FILTER_BYTES", -1)
    held = [(i, t, "en") for i, t, _ in rows() if i is not None and zlib.crc32(str(i).encode()) % 7 == 2]
    out = run(frame(spark, held))
    assert len(out) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in out)


def test_long_texts_and_many_bundles(spark, monkeypatch):
    rng = random.Random(8)
    data = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(30_000 if k % 40 == 0 else 300)), "en") for k in range(120)]
    want = sorted(map(tuple, run(frame(spark, data))))
    monkeypatch.setattr(L, "MAX_FILTER_BYTES", 1000)
    got = sorted(map(tuple, run(frame(spark, data).repartition(11))))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def grams(model, text):
    """(count of the token, of the pair that ends with it, of the token before, level of that) at each place, as the filter tells."""
    t = L.tokens([(text or "").encode()], 2)
    (c, lv), (pair, _) = (model.filter.look_up(k, t.grams[k - 1]) for k in (1, 2))
    return [(c[k], pair[k], c[k - 1], min(lv[k - 1], 63)) for k in range(1, len(c))]


def test_score_is_plain_interpolation_over_the_quantised_counts(spark):
    rng = random.Random(4)
    data = rows() + [(200 + k, " ".join(rng.choice("abcde") for _ in range(40)), "en") for k in range(80)]
    training = [t for i, t, _ in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    docs = frame(spark, data)
    model = L.learn(docs.where(~L.held_out()))
    total = model.n + model.v + 1
    gains = {}
    for text in training:
        for c, pair, before, lv in grams(model, text):
            if before > 1:      # its own occurrence is taken off
                p, ml = max(c, 1) / total, min(max(pair - 1, 0) / (before - 1), 1)
                for j, a in enumerate(L.WEIGHTS):
                    gains.setdefault(lv, [0.0] * len(L.WEIGHTS))[j] += math.log(p + a * (ml - p))
    weight, last = {0: 0.0}, 0.0
    for lv in range(1, 64):
        if lv in gains:
            last = L.WEIGHTS[max(range(len(L.WEIGHTS)), key=gains[lv].__getitem__)]
        weight[lv] = last
    np.testing.assert_allclose([weight[lv] for lv in range(64)], model.weights[1])
    want = []
    for i, text, _ in data:
        s = 0.0
        for c, pair, before, lv in grams(model, text):
            a = weight[lv] if before > 0 else 0.0
            s += math.log10(a * (min(pair / before, 1) if before > 0 else 0.0) + (1 - a) * (c + 1) / total)
        want.append((str(i), s))
    for scored in (L.score(docs, model).collect(), run(docs)):      # looked up apart, and at once
        got = sorted((str(r.doc_id), r.score) for r in scored)
        for a, b in zip(got, sorted(want), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9)
    assert max(model.weights[1]) > 0


def test_weights_come_from_all_training_documents(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcdefgh") for _ in range(8)), "en") for i in range(6000)]
    seen, tune = [], L._tune
    monkeypatch.setattr(L, "_tune", lambda rows, *more: (seen.append(rows.count()), tune(rows, *more))[1])
    L.learn(frame(spark, data).where(~L.held_out()))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(6000))] and seen[0] > 4000
