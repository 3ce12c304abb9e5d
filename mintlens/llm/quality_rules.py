"""Learned decision lists over text statistics.

Sequential covering: a rule is grown as a conjunction of thresholds, each the one with the greatest
information gain on two thirds of the labelled rows; pruned to the prefix that does best on
the other third; kept if it is precise enough on both; and its rows are taken out before
the next rule is grown. The list becomes one ordered Spark CASE expression.

DataFrame functions only. Candidate thresholds are quantiles of all labelled rows; every step of the
search is one grouped count over (statistic, bin, label), so the driver sees a few hundred counts
whatever the number of labelled rows.

Defined cases: null text has no words; rows without a label, or with a null one, teach nothing; with no
label of one of the two classes the list is empty and every row passes; repeated labels count each;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
QUANTILES = [k / 40 for k in range(41)]
MAX_RULES, MAX_CONDITIONS = 12, 3
LEAST_PRECISION, LEAST_SUPPORT = 0.9, 5

#: Statistics that rules may test, from the columns of :func:`measure`.
STATISTICS = {
    "n_words": F.col,
    "mean_word_chars": lambda _: F.try_divide(F.col("word_chars"), F.col("n_words")),
    "symbol_share": lambda _: F.try_divide(F.col("n_symbols"), F.col("n_words")),
    "dup_line_share": lambda _: F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
    "repeat_share": lambda _: F.try_divide(F.col("n_repeat_words"), F.col("n_words")),
    "upper_share": lambda _: F.try_divide(F.col("n_upper"), F.col("word_chars")),
}


class Condition(NamedTuple):
    statistic: str
    at_least: bool
    threshold: float


class DecisionList(NamedTuple):
    """Rules in order; the first that holds rejects. Nothing rejects a row that no rule fits."""

    rules: list[list[Condition]]

    def expression(self) -> Column:
        """Number of the rule that rejects the row, from the STATISTICS columns; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for c in rule:
                x = F.coalesce(F.col(c.statistic).cast("double"), F.lit(0.0))
                holds = holds & ((x >= c.threshold) if c.at_least else (x < c.threshold))
            out = F.when(holds, k) if out is None else out.when(holds, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        lines = [" and ".join(f"{c.statistic} {'>=' if c.at_least else '<'} {c.threshold:g}" for c in rule) for rule in self.rules]
        return "\n".join([*(f"{k}. reject if {x}" for k, x in enumerate(lines, 1)), "else keep"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper) of every whole text."""
    t = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("l"))
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_upper",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 4, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(
            F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # windows found twice: neighbours in sorted order (only where some window repeats at all)
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    s = F.col("s")
    again = F.filter(F.transform(s, lambda x, k: F.when(
        (x["h"] == F.when(k > 0, s[k - 1]["h"])) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("again", again)
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda i: F.array(i, i + 1, i + 2)))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       F.when(s.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"), "n_upper")


def with_statistics(measured: DataFrame) -> DataFrame:
    """``measured`` with the STATISTICS that it lacks."""
    return measured.withColumns({k: f(k) for k, f in STATISTICS.items() if k not in measured.columns})


def _entropy_gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """Information gained by the ``p`` rejected and ``n`` kept rows that stay, out of all."""
    if not p or not all_p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n)))


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """A decision list that rejects the rows labelled 0, from ``measured`` rows with a label of 0 or 1."""
    named = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    names = list(STATISTICS)
    rows = with_statistics(measured).join(named, "doc_id").select(
        "bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"),
        *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in names])
    rows = materialize(rows, "rules-labelled")
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(k, QUANTILES, 10_000).alias(k) for k in names]).collect()
    if len(cuts) < 2:
        return DecisionList([])
    thresholds = {k: sorted({v for r in cuts for v in r[k]}) for k in names}

    def bin_of(k: str) -> Column:      # number of thresholds reached
        return F.size(F.filter(F.array(*[F.lit(v) for v in thresholds[k]]), lambda v: v <= F.col(k)))

    bins = materialize(rows.select("bad", "fold", *[bin_of(k).alias(f"b{j}") for j, k in enumerate(names)]), "rules-bins")

    # a condition is (statistic number, at_least, number of the threshold)
    def holds(conditions: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for j, at_least, cut in conditions:
            out = out & ((F.col(f"b{j}") > cut) if at_least else (F.col(f"b{j}") <= cut))
        return out

    stacked = "stack({}, {}) as (j, b)".format(len(names), ", ".join(f"{j}, b{j}" for j in range(len(names))))
    found: list[list[tuple[int, bool, int]]] = []
    left = bins
    while len(found) < MAX_RULES:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            counts = left.where((F.col("fold") > 0) & holds(rule)).select("bad", F.expr(stacked)).groupBy(
                "j", "b", "bad").count().collect()
            table: dict[int, dict[int, list[int]]] = {}
            for r in counts:
                table.setdefault(r["j"], {}).setdefault(r["b"], [0, 0])[r["bad"]] += r["count"]
            best = (1e-9, 0, (0, True, 0))
            total = [sum(x[c] for x in table.get(0, {}).values()) for c in (0, 1)]
            for j in sorted(table):
                below = [0, 0]
                for cut in range(len(thresholds[names[j]])):
                    below = [below[c] + table[j].get(cut, (0, 0))[c] for c in (0, 1)]
                    for at_least, (n, p) in ((True, (total[0] - below[0], total[1] - below[1])), (False, tuple(below))):
                        if p + n < sum(total):
                            best = max(best, (_entropy_gain(p, n, total[1], total[0]), p, (j, at_least, cut)))
            if best[0] <= 1e-9:
                break
            rule.append(best[2])
            if best[1] and not total[0]:
                break
        if not rule:
            break
        sums = left.agg(*[F.count_if((F.col("fold") == 0) & (F.col("bad") == bad) & holds(rule[:k])).alias(f"p{k}_{bad}")
                          for k in range(1, len(rule) + 1) for bad in (0, 1)],
                        *[F.count_if((F.col("fold") > 0) & (F.col("bad") == bad) & holds(rule[:k])).alias(f"g{k}_{bad}")
                          for k in range(1, len(rule) + 1) for bad in (0, 1)]).first()

        def worth(k: int, fold: str = "p") -> float:
            p, n = sums[f"{fold}{k}_1"], sums[f"{fold}{k}_0"]
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), worth(k, "g"), -k))
        p, n = sums[f"p{k}_1"] + sums[f"g{k}_1"], sums[f"p{k}_0"] + sums[f"g{k}_0"]
        if p < LEAST_SUPPORT or p < LEAST_PRECISION * (p + n) or worth(k) < 2 * LEAST_PRECISION - 1:
            break
        found.append(rule[:k])
        left = left.where(~holds(rule[:k]))
    return DecisionList([[Condition(names[j], at_least, thresholds[names[j]][cut]) for j, at_least, cut in rule] for rule in found])


def apply(measured: DataFrame, rules: DecisionList, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """``measured`` with base_failed, rule (0: none rejects) and kept."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    out = with_statistics(measured).withColumn("base_failed", base).withColumn("rule", rules.expression())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
