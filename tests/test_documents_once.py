"""Documents are built, read and parsed once: what a text holds is not worked out again for each use of it."""

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from conftest import SF_SMALL
from mintlens.operators import parse
from mintlens.plans.queries import QUERIES
from mintlens.sources import fixtures as fx
from mintlens.streaming import capture


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_wallet_document_is_parsed_once(spark):
    plan = plan_of(QUERIES["wallet_json"](spark, SF_SMALL))
    assert plan.count("from_json") >= 1 and "get_json_object" not in plan and "json_array_length" not in plan


def test_redelivered_documents_are_built_once(spark, monkeypatch):
    plans, body = [], capture.BlockCapture.__call__
    monkeypatch.setattr(capture.BlockCapture, "__call__", lambda self, batch, epoch: (plans.append(plan_of(batch)), body(self, batch, epoch))[1])
    QUERIES["replayed_sales"](spark, SF_SMALL)
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)


def test_landed_blocks_are_written_by_all_tasks(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the landing is written by a fixed number of tasks")
    monkeypatch.setattr(ClassicFrame, "coalesce", refuse)
    assert QUERIES["start_at_tip"](spark, SF_SMALL).count() > 0


def test_a_nested_value_of_a_document_is_named_once(spark):
    inner = fx._obj(("b", fx._obj(("c", F.col("marker")))))
    assert str(inner._jc).count("marker") == 1
    rows = spark.createDataFrame([("1",), (None,)], "marker string").select(inner.alias("j")).collect()
    assert [r.j for r in rows] == ['{"b":{"c":1}}', '{"b":{}}']


def test_judging_builds_no_schema(spark):
    text = ['{"blockNumber":1}', ' \t{"blockNumber":2}', "[1]", '"{"', "{", '{"a":1}', "3"]
    docs = spark.createDataFrame([(t,) for t in text], "value string")
    judged = parse.judged_documents(docs)
    assert "schema_of_variant" not in plan_of(judged).lower()
    assert [r.reason for r in judged.collect()] == [None, None, "not a JSON object", "not a JSON object", "not a JSON object",
                                                    "no block number", "not a JSON object"]


def test_typed_blocks_of_a_backfill_are_not_stored_before_the_parse(spark, monkeypatch, tmp_path):
    kept, persist = [], ClassicFrame.persist
    monkeypatch.setattr(ClassicFrame, "persist", lambda self, *a: (kept.append(self.columns), persist(self, *a))[1])
    docs = spark.createDataFrame([('{"blockNumber":5,"transactions":[]}',)], "value string")
    capture.backfill(spark, parse.blocks_from_json(docs), f"{tmp_path}")
    assert not any("transactions" in cols for cols in kept)


def test_present_null_key_still_wins(spark):
    from mintlens.functions import first_present
    m = F.from_json("t", "map<string,string>")
    df = spark.createDataFrame([('{"a":null,"b":"2"}',), ('{"b":"2"}',), ('{"a":"1","b":"2"}',), ("{}",)], "t string")
    assert [r[0] for r in df.select(first_present(m, "a", "b")).collect()] == [None, "2", "1", None]
