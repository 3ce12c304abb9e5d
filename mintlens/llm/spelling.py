"""Spelling variants: words one code point apart, found by pairs of trie nodes.

The vocabulary is sorted and its forward trie numbered in one scan of each sorted range: a word has
the nodes of its predecessor up to their common prefix, and new numbers below. Where a range starts
inside a prefix of the one before, the numbers of that path are carried over (``_seams``). The
reversed words give the numbers of the suffixes. With P(i) the node of the first i code points of a
word and S(k) that of its last k, a word of length L has

* the split pairs (P(i), S(L - i)), which name no word but itself, and
* the skip pairs (P(i), S(L - i - 1)), code point i skipped.

Two words differ by one replaced code point if and only if they share a skip pair, and by one inserted
or deleted one if and only if a skip pair of the longer is a split pair of the shorter; of equal
neighbouring code points the first stands for all. So neighbours are exact, each found once, and
a pair of integers is met by at most one word a code point of the alphabet (90 letters) and one split
word: no group grows with the corpus, and each member takes its count and its best neighbour from its
group without the pairs being written out. Word numbers follow (n falling, word), so that the best of
several words is the least number.

Counting, grouping and following of forms are DataFrame functions; nodes are numbered in sorted Arrow
batches. The driver sees one word a range.

Defined cases: null and empty texts have no words; a null id counts as an empty string; rows with equal
ids are counted each; words of any length are kept whole; an empty vocabulary gives no rows.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

RUN = "[A-Za-zÀ-ÿ]+"
ODDS = 97           # one run of so many loses a code point
MIN_CHARS, MIN_COUNT = 5, 3
RATIO = 2           # a form is at least so many times as frequent


def occurrence(doc_id: Column, run: Column) -> Column:
    """The word that a run counts as: lower-case A-Z, and one of 97 by hash without one code point."""
    low = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = (h % F.char_length(low)).cast("int")
    cut = F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.char_length(low)))
    return F.when(h % ODDS == 0, cut).otherwise(low)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(id, word, n): the distinct words; ids follow falling n, then the word in code-point order."""
    runs = docs.select(F.col(id_col).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("r"))
    words = runs.where(F.char_length("r") >= min_chars).select(occurrence(F.col("i"), F.col("r")).alias("word"))
    counted = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where(F.col("n") >= min_count).orderBy(F.desc("n"), "word")
    return materialize(kept.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _common(a: str, b: str, most: int | None = None) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b)) if most is None else min(len(a), len(b), most)
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))


def _number(batches):
    """Sorted (id, word) -> (part, id, word, nodes): the nodes at depth 1, 2 ... of each word."""
    part = TaskContext.get().partitionId()
    last, nodes, free = "", np.empty(0, np.int64), (part << 40) + 1
    for batch in batches:
        words, out = batch.column(1).to_pylist(), []
        for word in words:
            k = _common(last, word)
            nodes = np.concatenate([nodes[:k], np.arange(free, free + len(word) - k)])
            free += len(word) - k
            last = word
            out.append(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), part), pa.int32()), batch.column(0), batch.column(1),
                                          _ragged(out)], ["part", "id", "word", "nodes"])


def _seams(numbered: DataFrame) -> dict[int, tuple[str, np.ndarray]]:
    """part -> (its first word, numbers of the nodes on that word's path which an earlier part has made)."""
    ends = numbered.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"),
                                        F.max_by("nodes", "word").alias("nodes")).orderBy("part").collect()
    out, last, path = {}, "", np.empty(0, np.int64)
    for r in ends:
        carried = path[:_common(last, r["first"])]
        if len(carried):
            out[r["part"]] = (r["first"], carried)
        path = np.array(r["nodes"], np.int64)
        k = _common(r["first"], r["last"], len(carried))
        path[:k] = carried[:k]
        last = r["last"]
    return out


def _nodes(words: DataFrame, tag: str) -> DataFrame:
    """(id, ``tag``): numbers of the trie nodes of every (id, word), without the root."""
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    numbered = materialize(map_arrow(ordered, _number, "part int, id bigint, word string, nodes array<bigint>"), f"trie-{tag}")
    seams = _seams(numbered)

    def carry(batches):
        for batch in batches:
            out, flat = [], batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            for at, (part, word) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                nodes = flat[ends[at]:ends[at + 1]]
                first, carried = seams.get(part, ("", ()))
                if k := _common(word, first, len(carried)):
                    nodes = np.concatenate([carried[:k], nodes[k:]])
                out.append(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(1), _ragged(out)], ["id", tag])

    return map_arrow(numbered, carry, f"id bigint, {tag} array<bigint>")


def _pairs(batches):
    """(id, word, p, s) -> (p, s, id, kind): split pairs (kind 0), skip pairs (1; 2: stands for its equal neighbours)."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(size + 1) - size - 1      # each word's nodes with the root, 0, before them
        flat = []
        for column in (2, 3):
            f = np.zeros(int((size + 1).sum()), np.int64)
            inner = np.ones(len(f), bool)
            inner[start] = False
            f[inner] = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            flat.append(f)
        p, s = flat
        i = np.arange(len(p)) - np.repeat(start, size + 1)
        back = np.repeat(start + size, size + 1) - i
        owner = np.repeat(ids, size + 1)
        skip = i < np.repeat(size, size + 1)
        new = np.ones(len(chars), bool)
        new[1:] = chars[1:] != chars[:-1]
        new |= i[skip] == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([p, p[skip]])), pa.array(np.concatenate([s[back], s[back[skip] - 1]])),
             pa.array(np.concatenate([owner, owner[skip]])),
             pa.array(np.concatenate([np.zeros(len(p), np.int8), 1 + new.astype(np.int8)]))], ["p", "s", "id", "kind"])


def near_words(vocab: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have a near one; ``best`` is the least id of those."""
    forward = _nodes(vocab.select("id", "word"), "p")
    backward = _nodes(vocab.select("id", F.reverse("word").alias("word")), "s")
    both = vocab.select("id", "word").join(forward, "id").join(backward, "id")
    pairs = map_arrow(both.select("id", "word", "p", "s"), _pairs, "p bigint, s bigint, id bigint, kind tinyint")
    # at most one word a letter, and one split word
    group = pairs.groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") > 0, F.struct("id", "kind")))).alias("skips"),
        F.max(F.when(F.col("kind") == 0, F.col("id"))).alias("split"))
    group = group.where(F.size("skips") + F.col("split").isNotNull().cast("int") >= 2)
    n, split = F.size("skips"), F.col("split")
    first, second = F.col("skips")[0]["id"], F.get(F.col("skips"), F.lit(1))["id"]
    heads = F.filter("skips", lambda m: m["kind"] == 2)
    of_skips = F.transform("skips", lambda m: F.struct(
        m["id"].alias("id"),
        (n - 1 + ((m["kind"] == 2) & split.isNotNull()).cast("int")).cast("long").alias("near"),
        F.least(F.when(m["id"] == first, second).otherwise(first), F.when(m["kind"] == 2, split)).alias("best")))
    of_split = F.when(split.isNotNull(), F.array(F.struct(
        split.alias("id"), F.size(heads).cast("long").alias("near"), F.get(heads, F.lit(0))["id"].alias("best"))))
    members = group.select(F.explode(F.concat(of_skips, F.coalesce(of_split, F.array()))).alias("m")).select("m.*")
    return members.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): forms followed to the last. A form has twice the count, so paths are short."""
    cur = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("id").alias("root"), F.col("root").alias("next"))
        found = materialize(cur.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "roots")
        cur = found.select("id", "root")
        if not found.where("moved").limit(1).count():
            return cur


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a ``vocabulary``."""
    best = vocab.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
    near = near_words(vocab).join(best, "best")
    judged = materialize(vocab.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "near-words")
    forms = judged.where("form IS NOT NULL").select("id", "form")
    names = vocab.select(F.col("id").alias("at"), F.col("word").alias("name"))
    named = forms.join(_roots(forms), "id")
    named = named.join(names.withColumnsRenamed({"at": "form", "name": "form_word"}), "form").join(
        names.withColumnsRenamed({"at": "root", "name": "root_word"}), "root").select("id", "form_word", "root_word")
    return judged.drop("form").join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
