import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mintlens.llm import decontamination as D

from .corpus import DOCS, frame, lines, rows, words

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def grams(text):
    w = WORD.findall((text or "").encode().lower()) if text else []
    return [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def plain(docs, items):
    """Brute force: best weighted similarity of any window of the item's size, for each text and item."""
    have = Counter(g for _, t in items for g in set(grams(t)))
    n = sum(bool(grams(t)) for _, t in items)
    weight = lambda g: 1 + math.log(n / have[g]) if g in have else 1 + math.log(n)
    out = {}
    for i, text in docs:
        d = grams(text)
        for j, t in items:
            g = Counter(grams(t))
            size = min(sum(g.values()), len(d))
            for a in range(len(d) - size + 1 if size else 0):
                w = Counter(d[a:a + size])
                s = sum(weight(x) * min(g[x], w[x]) for x in g) / sum(weight(x) * max(g[x], w[x]) for x in g | w)
                if s >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), round(s, 6))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(21)
    items = [(k, words(rng, rng.randint(12, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, "?!")]
    items.append((94, items[0][1]))
    docs = [(i, t) for i, t, _ in rows(n=20) if i != 106]
    for k, (_, t) in enumerate(items[:40]):
        body = [lines(rng, 4), lines(rng, 3)]
        w = t.split()
        if k % 4 == 1:
            t = t.upper().replace(" ", "  ") + "!"
        elif k % 4 == 2:
            w[-1] = "changed"
            t = " ".join(w)
        elif k % 4 == 3:
            t = " ".join(w[: len(w) // 2])         # half of an item is no leak
        docs.append((500 + k, f"{body[0]}\n{t}\n{body[1]}"))
    docs += [(600, items[5][1]), (601, "Two, words."), (602, items[7][1] + " " + items[7][1]), (603, items[3][1] * 2)]
    return docs, items


def test_matches_brute_force(spark, case):
    docs, items = case
    found = D.find_leaks(frame(spark, [(i, t, "en") for i, t in docs], clash=True), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found.collect()}
    assert got == plain(docs, items)
    assert len(got) > 25


def test_passes_over_the_items_agree(spark, case, monkeypatch):
    docs, items = case
    frames = frame(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id) for r in D.find_leaks(*frames).collect()}
    monkeypatch.setattr(D, "ITEMS_A_PASS", 7)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(*frames).collect()} == whole
    bad = {i for i, _ in whole}
    assert {r.doc_id for r in D.remove_leaks(*frames).collect()} == {i for i, _ in docs} - bad


def test_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(2)
    items = D.Items(tuple((k, words(random.Random(k), 30).encode()) for k in range(12)))
    size, = items.tables
    prints = []
    for k in range(12):
        for r in range(D.RADIUS + 6):
            flip = sum(1 << int(b) for b in rng.choice(64, r, replace=False))
            prints.append(int(items.fingerprints[k]) ^ flip)
    prints = np.array(prints, np.uint64)
    got = {(k, w) for k, at in items.candidates(size, prints) for w in at.tolist()}
    want = {(k, w) for k in range(12) for w in range(len(prints))
            if (int(prints[w]) ^ int(items.fingerprints[k])).bit_count() <= D.RADIUS}
    assert got == want


def test_windows_like_plain_sums():
    hashes, count = D.shingles([words(random.Random(1), 500).encode(), b"", words(random.Random(2), 90).encode()])
    for widest in (50, 400):
        ones = D.ones_before(hashes, widest)
        start, end = np.array([0, 3, 100]), np.array([50, 40, 100 + min(widest, 300)])
        for a, b, p in zip(start, end, D.window_fingerprints(ones, start, end)):
            bits = [sum(int(h) >> k & 1 for h in hashes[a:b]) for k in range(64)]
            assert int(p) == sum(1 << k for k in range(64) if 2 * bits[k] > b - a)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_leaks(docs, bench).collect() == []
    assert D.find_leaks(frame(spark), bench).collect() == []
    assert len(D.remove_leaks(frame(spark), bench).collect()) == len(rows())


def test_recall_at_the_border():
    """Items of 45 and 90 shingles with inner words changed, just above the similarity asked for."""
    rng = random.Random(1)
    word = lambda: f"{rng.getrandbits(40):x}"
    items, docs = [], []
    for k in range(300):
        w = [word() for _ in range((49, 94)[k % 2])]
        items.append((k, " ".join(w).encode()))
        for at in ((20,), (25, 65))[k % 2]:
            w[at + rng.randint(-8, 8)] = "changed"
        docs.append(" ".join([*(word() for _ in range(rng.randint(30, 200))), *w, *(word() for _ in range(60))]).encode())
    held, missed = D.Items(tuple(items)), 0
    found = {(d, held.ids[k]) for d, k, s, _, _ in held.matches(docs, 0.79)}
    for k, text in enumerate(docs):
        hashes, _ = D.shingles([text])
        assert 0.79 <= held.best_window(k, hashes, 0, len(hashes))[0] <= 0.82
        missed += (k, k) not in found
    assert missed <= 1


def test_similarity_does_not_depend_on_the_passes(spark, monkeypatch):
    rng = random.Random(8)
    boilerplate = words(rng, 14)
    items = [(k, words(rng, 30) + " " + boilerplate) for k in range(24)]
    docs = []
    for k, t in items:
        w = t.split()
        w[k % 3 or -1] = "changed"
        docs.append((k, lines(rng, 2) + "\n" + " ".join(w) + "\n" + lines(rng, 2)))
    frames = frame(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (2048, 5):
        monkeypatch.setattr(D, "ITEMS_A_PASS", most)
        got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in D.find_leaks(*frames).collect()}
        assert got == plain(docs, items) and len(got) >= 24


def test_texts_shorter_than_an_item(spark):
    """Items that share boilerplate; texts that hold their own words only, or most of them: similar by weight, however much shorter."""
    rng = random.Random(4)
    shared = words(rng, 40)
    items = [(k, words(rng, rng.choice([25, 40, 60])) + " " + shared) for k in range(60)] + [(99, words(rng, 7))]
    docs = []
    for k, t in items[:60]:
        own = t.split()[:-40]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[rng.randint(0, 3):]))]
    docs += [(900, shared), (901, " ".join(items[60][1].split()[:6])), (902, None), (903, "one"), (904, " ".join(items[60][1].split()[:5]))]
    items.append((98, words(rng, 42)))       # of the class of 40 shingles, with 38: a text may be longer and yet below the class
    docs += [(910, "zq " + items[61][1]), (911, "zq " + items[61][1].rsplit(" ", 1)[0])]
    found = D.find_leaks(frame(spark, [(i, t, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), 0.8)
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found.collect()}
    want = plain(docs, items)
    assert got == want and want[910, 98] == 1.0 and len(want) > 30 and min(want.values()) < 0.85
