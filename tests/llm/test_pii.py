import hashlib
import random
import re
import time

import numpy as np
import pytest

from mintlens.llm import pii as P

from .corpus import frame, rows

STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stated_spans(text):
    """The patterns as they are stated, tried from every character."""
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            double = [c * 2 - 9 * (c > 4) if k % 2 else c for k, c in enumerate(reversed(d))]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(double) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def field():
    return P.train()


def test_base_patterns_equal_the_stated_ones():
    rng = random.Random(3)
    pieces = ["a", "b@", "@", ".", "c.de", "1", "25", "256", "0255", "1.2.3.4", "+", "+1", " ", "-", "(", ")", "4111111111111111",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "+1 (551) 555-0826", "x@y.z", "_%", "\n"]
    found = 0
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert P.base_spans(text) == stated_spans(text), text
        found += len(stated_spans(text))
    assert found > 3000


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 3_000_000, "1" * 3_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "a@" * 500_000, "1 " * 1_000_000):
        P.base_spans(text)
    assert time.time() - began < 60


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    sets = [("plain",), ("edge",), ("a", "b"), ("b",), ("c",)]
    field = P.Field(["plain", "edge", "a", "b", "c"])
    field.weight[:] = rng.standard_normal(field.weight.shape) * 0.4
    field.move[:] = rng.standard_normal(field.move.shape) * 0.4
    field.alone[:] = rng.standard_normal(len(P.LABELS)) * 0.4
    sequences = [rng.choice([0, 0, 0, 2, 3, 4], n) for n in (1, 9, 4, 6)]
    goals = [rng.integers(0, len(P.LABELS), len(s)) for s in sequences]
    has = np.array([[n in s for n in field.names] for s in sets], float)
    x, y, live = P._padded(sequences, goals)
    _, *grads = field.gradient(x, y, live, has)
    for param, grad in zip((field.weight, field.alone, field.move), grads):
        for at in [tuple(int(rng.integers(0, s)) for s in param.shape) for _ in range(25)]:
            old = param[at]
            param[at] = old + 1e-5
            up = field.gradient(x, y, live, has)[0]
            param[at] = old - 1e-5
            down = field.gradient(x, y, live, has)[0]
            param[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def plain_viterbi(field, sets, classes):
    """Best labels of one text, word by word, without any shortcut."""
    table = field.table(sets)
    get = lambda k: classes[k] if 0 <= k < len(classes) else P.EDGE_OF_TEXT
    score, back = None, []
    for t in range(len(classes)):
        e = sum(table[r][get(t + off)] for r, off in enumerate(P.REACH))
        if all(get(t + off) <= P.EDGE_OF_TEXT for off in P.REACH):
            e = e + field.alone
        if score is None:
            score = field.move[0] + e
        else:
            through = score[:, None] + field.move
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + e
    out = [int((score + field.move[:, 0]).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_decoding_equals_plain_viterbi(field):
    texts = [t for t, _ in P.labelled_table(120, seed=31)] + [r[1] for r in rows() if r[1] and len(r[1]) < 3000] + ["", " ", "(551) 555-0826"]
    finder = P.Finder(field)
    words = P.Words(*P._buffer(texts))
    got = finder.labels(words)
    classes = words.classes(finder.classes)
    assert [words.raw[a:b].tobytes().decode() for a, b in zip(words.start, words.stop)] == [
        w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    for k in range(len(texts)):
        mine = classes[words.doc == k].tolist()
        if mine:
            assert got[words.doc == k].tolist() == plain_viterbi(field, finder.classes.sets, mine)
    assert (got > 0).sum() > 100


def test_untrained_field_decodes_alike():
    """Without the lead of plain words nothing is skipped."""
    field = P.Field(["plain", "edge", "digits=8"])
    rng = np.random.default_rng(5)
    for p in (field.weight, field.alone, field.move):
        p[:] = rng.standard_normal(p.shape)
    finder = P.Finder(field)
    texts = ["one two 12345678 three", "x", "12345678 12345678 a b c d e f"]
    words = P.Words(*P._buffer(texts))
    got, classes = finder.labels(words), words.classes(finder.classes)
    for k in range(3):
        assert got[words.doc == k].tolist() == plain_viterbi(field, finder.classes.sets, classes[words.doc == k].tolist())


def test_held_out_spans(field):
    """A table of another seed: what is found of what the base patterns cannot find, and what is found wrongly."""
    finder, hit, wrong, missed = P.Finder(field), 0, 0, 0
    for text, spans in P.labelled_table(400, seed=77):
        base, added = finder.find(*P._buffer([text])).get(0, ([], []))
        beyond = [s for s in spans if not any(b[1] < s[2] and b[2] > s[1] for b in base)]
        hit += len(set(added) & set(beyond))
        missed += len(set(beyond) - set(added))
        wrong += len(set(added) - set(spans))
    assert hit > 180 and hit / (hit + missed) > 0.9 and wrong <= 0.05 * hit


def test_decoys_are_left_alone(field):
    finder = P.Finder(field)
    for text in ("the 4111111111111112 word", 'token = "4ad6a67af5fb7b55c0dc0a94ac13d93d23de55a9" is', "on 2024-05-17 at 12:30",
                 "look at the dot on the page", "costs $1,299.00 (or 12) now", "phone call at ten", ""):
        assert finder.find(*P._buffer([text])) == {}


def test_known_forms(field):
    finder = P.Finder(field)
    text = "é ask jane [at] mail [dot] org, or call (551) 555-0826. x@y.zz"
    base, added = finder.find(*P._buffer(["", text]))[1]
    assert base == [("email", text.index("x@"), len(text))]
    assert added == [("email", text.index("jane"), text.index(", or")), ("phone", text.index("("), text.index(". x@"))]


def test_rows(spark, field):
    data = rows() + [(400, "mail a.b@c.de and +1 (551) 555-0826, 10.0.0.1\t4111 1111 1111 1111", None), (400, "(551) 555-0826", None)]
    data += [(401, "w " * 60_000 + "😀 a@b.cc " + "(551) 555-0826", None)]
    out = P.find_personal(frame(spark, data, clash=True).repartition(3), field).collect()
    assert len(out) == len(data)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _ in data:
        want = stated_spans(text or "")
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        r = next(r for r in by[doc_id] if r.base_sha256 == sha)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in P.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
        assert len(want) + r.n_added == len(r.spans.split(",")) - (r.spans == "")
    assert by[401][0].spans == "email:120002:120008,phone:120009:120023"


def test_empty(spark, field):
    assert P.find_personal(frame(spark, []), field).count() == 0
    only = P.find_personal(frame(spark, [(1, None, None), (None, "", None)]), field).collect()
    assert [(r.spans, r.n_added, r.base_sha256) for r in only] == [("", 0, hashlib.sha256(b"").hexdigest())] * 2
