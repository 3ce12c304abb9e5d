import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mintlens.llm import quality_rules as Q

from .corpus import DOCS, frame, rows, words

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w, ls = W.findall(t), [x for x in t.split("\n") if W.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def awkward():
    rng = random.Random(5)
    data = [(i, t) for i, t, _ in rows()]
    data += [(300 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for k in range(40)]
    data += [(400, "a b c a b c"), (401, "a a a"), (402, "a a a a"), (403, "x\ny\nx\n\nx\n y"), (404, "#*$ %&| <> 漢#")]
    return data


def test_statistics_match_brute_force(spark):
    data = awkward()
    got = Q.measure(frame(spark, [(i, t, "en") for i, t in data], clash=True)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain(t)) for i, t in data), key=str)


def labelled(spark, n=400):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(n):
        w = words(rng, rng.randint(60, 120)).split()
        bad = k % 4 == 0
        if bad:
            w = [x + rng.choice(["###", "|", "%%"]) for x in w] if k % 8 else [x.upper() for x in w]
        docs.append((k, " ".join(w), "en"))
        if k % 3:
            labels.append((k, int(not bad), 0))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_both_kinds_of_junk(spark):
    docs, labels = labelled(spark)
    measured = Q.measure(docs)
    rules = Q.learn(measured, labels)
    assert 2 <= len(rules.rules) <= 4 and "reject if" in str(rules)
    out = Q.apply(measured, rules).collect()
    good, bad = ([r for r in out if (r.doc_id % 4 != 0) == x and not r.base_failed] for x in (True, False))
    assert sum(not r.kept for r in good) <= 0.01 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    assert not any(r.kept for r in out if r.base_failed)


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark, 40)
    measured = Q.measure(docs)
    for some in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        rules = Q.learn(measured, some)
        assert rules.rules == []
        assert all(r.kept != r.base_failed for r in Q.apply(measured, rules).collect())


def test_expression_is_ordered(spark):
    rules = Q.DecisionList([[Q.Condition("n_words", True, 5.0), Q.Condition("n_words", False, 9.0)], [Q.Condition("n_words", True, 3.0)]])
    df = spark.createDataFrame([(k,) for k in (1, 4, 6, 20)], "n_words int")
    assert [r.x for r in df.select(rules.expression().alias("x")).collect()] == [0, 2, 1, 2]


def test_no_python_in_the_plan(spark):
    docs, _ = labelled(spark, 10)
    plan = Q.apply(Q.measure(docs), Q.DecisionList([]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    measured = Q.measure(spark.createDataFrame([], DOCS))
    assert Q.apply(measured, Q.DecisionList([])).collect() == []


def plain_list(rows, names):
    """Covering by trying every threshold on every row; ``rows`` are (bad, fold, values)."""
    def gain(some, picked):
        p, n = sum(b for b, _, _ in picked), sum(not b for b, _, _ in picked)
        all_p = sum(b for b, _, _ in some)
        return p * (math.log2(p / (p + n)) - math.log2(all_p / len(some))) if p else 0.0

    def fits(rule, v):
        return all((v[j] >= x) if at_least else (v[j] < x) for j, at_least, x in rule)

    def worth(rule, some):
        hit = [b for b, _, v in some if fits(rule, v)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    out, cuts = [], [sorted({v[j] for _, _, v in rows}) for j in range(len(names))]
    while len(out) < Q.MAX_RULES:
        grow, prune, rule = [r for r in rows if r[1]], [r for r in rows if not r[1]], []
        while len(rule) < Q.MAX_CONDITIONS:
            here, best = [r for r in grow if fits(rule, r[2])], (1e-9, 0, None)
            for j in range(len(names)):
                for c, x in enumerate(cuts[j]):
                    for at_least in (True, False):
                        picked = [r for r in here if (r[2][j] >= x) == at_least]
                        if len(picked) < len(here):
                            best = max(best, (gain(here, picked), sum(b for b, _, _ in picked), (j, at_least, c)), key=lambda y: (y[0], y[1], y[2] or ()))
            if best[2] is None:
                break
            j, at_least, c = best[2]
            rule.append((j, at_least, cuts[j][c]))
            if all(r[0] for r in here):
                break
        if not rule:
            break
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k], prune), worth(rule[:k], grow), -k))
        hit = [b for b, _, v in rows if fits(rule[:k], v)]
        if sum(hit) < Q.LEAST_SUPPORT or sum(hit) < Q.LEAST_PRECISION * len(hit) or worth(rule[:k], prune) < 2 * Q.LEAST_PRECISION - 1:
            break
        out.append(rule[:k])
        rows = [r for r in rows if not fits(rule[:k], r[2])]
    return [[(names[j], at_least, x) for j, at_least, x in rule] for rule in out]


def test_learned_list_equals_plain_covering(spark):
    rng, names = random.Random(12), list(Q.STATISTICS)
    data = []
    for i in range(70):      # few enough that every value is a candidate threshold
        v = [round(rng.uniform(0, 1), 3) for _ in names]
        data.append((i, 0 if v[2] > 0.7 or (v[3] > 0.5 and v[4] < 0.4) else 1, *v))
    assert all(20 < sum(r[1] == c for r in data) <= 40 for c in (0, 1))
    df = spark.createDataFrame(data, "doc_id long, quality int, " + ", ".join(f"{k} double" for k in names))
    folds = {r.doc_id: r.fold for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 3) as fold").collect()}
    got = Q.learn(df.drop("quality"), df.select("doc_id", "quality"))
    want = plain_list([(r[1] == 0, folds[r[0]], r[2:]) for r in data], names)
    assert len(want) >= 1 and [[tuple(c) for c in rule] for rule in got.rules] == want
