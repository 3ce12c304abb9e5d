import hashlib
import os
import subprocess
import sys

import corpus_pipeline
from mintlens.llm import byte_bpe, common, decontamination, language_id, line_dedup, queries, simhash_dedup
from mintlens.llm.common import table

from .test_decontamination import plain as plain_leaks
from .test_line_dedup import plain as plain_lines
from .test_simhash_dedup import plain_classes, plain_fingerprint

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept; the learned one is repeated, the others recomputed plainly."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "byte_bpe"]
    held = [(r.doc_id, r.text) for r in docs.collect()]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == columns
        docs = common.materialize(out, "test-stage")
        outs.append(docs.collect())
    first = [(r.doc_id, r.text) for r in outs[0]]
    assert set(first) <= set(held) and len(first) >= 0.97 * len(held)
    second = {i: t for i, t in plain_lines(first)}
    before = dict(first)
    assert {r.doc_id: r.text for r in outs[1]} == {i: t for i, t in second.items() if t == before[i] or t.strip()}
    rows = sorted((r.doc_id, r.text) for r in outs[1])
    of = plain_classes([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, of):
        least.setdefault(c, i)
    assert {r.doc_id for r in outs[2]} == set(least.values())
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, _ in plain_leaks([(r.doc_id, r.text) for r in outs[2]], bench)}
    assert leaks and {r.doc_id for r in outs[3]} == {r.doc_id for r in outs[2]} - leaks
    assert {r.doc_id: r.decoded_sha256 for r in outs[4]} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in outs[3]}


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    for module in (byte_bpe, decontamination, language_id, line_dedup, simhash_dedup):
        assert module in list(vars(corpus_pipeline).values())


def test_rest_imports_without_the_optional_part(tmp_path):
    code = ("import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('mintlens.llm'):\n"
            "            raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\n"
            "assert 'market_floor' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
