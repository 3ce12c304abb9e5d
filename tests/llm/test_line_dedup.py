import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from mintlens.llm import line_dedup as L

from .corpus import DOCS, HELPERS, clashing, frame, lines, own_columns, rows


def plain(data):
    """Brute force: (doc_id, text) -> text without the covered lines."""
    word = re.compile(r"[^\x20\x09-\x0D]")
    first, places = {}, []
    for i, t in data:
        ls = t.split("\n") if t is not None else []
        at = [k for k, x in enumerate(ls) if word.search(x)]
        for p in range(len(at) - 2):
            w = tuple(ls[at[p + d]] for d in range(3))
            key = (-1 if i is None else i, p)
            first[w] = min(first.get(w, key), key)
            places.append((i, t, w, key, at[p:p + 3]))
    gone = {}
    for i, t, w, key, at in places:
        if key > first[w]:
            gone.setdefault((i, t), set()).update(at)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())))
            for i, t in data]


def awkward():
    rng = random.Random(8)
    shared = lines(rng, 5)
    data = [(i, t) for i, t, _ in rows()]
    data += [(200 + k, "\n".join([lines(rng, 2), shared, lines(rng, rng.randint(0, 3))])) for k in range(6)]
    data += [(210, shared), (211, "\n".join(["r e p"] * 9)), (212, "a\n\nb\n \nc"), (213, "a\nb\n\n\nc"), (214, "a\nb"), (215, "a\nb")]
    data += [(216, lines(rng, 400)), (217, "q\n" + shared.replace("\n", "\n\n"))]
    return data


def test_matches_brute_force(spark):
    data = awkward()
    docs = frame(spark, [(i, t, "en") for i, t in data], clash=True)
    out = L.remove_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(plain(data), key=str)


def test_oracle_agrees(spark):
    data = [(i, t) for i, t in awkward() if i not in (None, 108, 109)]
    documents = pd.DataFrame(data, columns=["doc_id", "text"])  # noqa: F841 -- read by DuckDB
    want = sorted(duckdb.sql(L.ORACLE).fetchall(), key=str)
    out = L.remove_lines(frame(spark, [(i, t, "en") for i, t in data]))
    got = out.select("doc_id", "__n_lines", "__n_removed", "text").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_emptied_documents_go(spark):
    data = awkward()
    docs = frame(spark, [(i, t, "en") for i, t in data]).withColumn("n_chars", F.length("text"))
    kept = {r.doc_id: r for r in L.dedup_documents(docs).collect()}
    assert 210 not in kept and 215 in kept and 101 in kept and 100 in kept
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.values())


def test_no_python_in_the_plan(spark):
    plan = L.remove_lines(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert L.remove_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_columns_named_like_the_helpers(spark):
    data = awkward()
    docs = clashing(frame(spark, [(i, t, "en") for i, t in data]))
    out = L.remove_lines(docs)
    assert out.columns == [*docs.columns, "___n_lines", "___n_removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(plain(data), key=str)
    own_columns(got, text=False)
    kept = L.dedup_documents(docs.withColumn("n_chars", F.length("text")))
    assert kept.columns == [*docs.columns, "n_chars"] and set(HELPERS) <= set(kept.columns)
    own_columns(kept.collect(), text=False)
    plainly = L.dedup_documents(docs.select("doc_id", "text", "lang"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((r.doc_id, r.text) for r in plainly.collect()), key=str)
