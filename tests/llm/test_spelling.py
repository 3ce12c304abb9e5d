import random
import re
import zlib
from collections import Counter

import pytest

from mintlens.llm import spelling as S

from .corpus import frame, rows


def plain_counts(data):
    found = Counter()
    for doc_id, text, _ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain(counts):
    form, near = {}, {}
    for w, n in counts.items():
        close = [u for u in counts if apart_by_one(w, u)]
        near[w] = len(close)
        best = min(close, key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def garbled(seed, n=700, letters="abé"):
    """Words of few letters, so that most have neighbours, with skewed counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(150)]
    text = [" ".join(rng.choice(words[:rng.randint(1, 150)]) for _ in range(40)) for _ in range(n // 10)]
    return [(k, t.upper() if k % 9 == 0 else t, "en") for k, t in enumerate(text)]


def got(spark, data, parts=4):
    vocab = S.vocabulary(frame(spark, data, clash=True).repartition(parts))
    return sorted(map(tuple, S.variants(vocab).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    data = garbled(seed)
    want = plain(plain_counts(data))
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert got(spark, data) == sorted(want, key=repr)


def test_ranges_that_split_a_prefix(spark):
    data = garbled(5)
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert got(spark, data) == sorted(plain(plain_counts(data)), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_awkward_rows(spark):
    data = rows() + [(200 + k, "resumé resumé résumé resume " + "q" * 40_000 + " " + "q" * 40_001, None) for k in range(4)]
    data += [(300, "ÀÉßxy àéßxy ÀÉßxy ÀÉßXY", None)] * 2
    assert got(spark, data) == sorted(plain(plain_counts(data)), key=repr)


def test_empty(spark):
    for data in ([], [(1, None, None), (2, "", None), (3, "one two", None)]):
        assert got(spark, data) == []


def test_common_prefix():
    assert S._common("abc", "abd") == 2 and S._common("abc", "abd", 1) == 1 and S._common("", "x") == 0
    assert S._common("abc", "abcd") == 3 and S._common("xbc", "abc") == 0
