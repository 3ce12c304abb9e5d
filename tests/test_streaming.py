"""Capture stream and sinks: replay safety, settle margin, start block,
backfill mode, retention, JSON rendering."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from mintlens.sources import sinks
from mintlens.streaming import capture


def _doc(n, events, ts="2026-07-10T00:00:00"):
    txs = [{"contract": "nft", "action": "transfer", "sender": a, "transactionId": f"t{n}-{i}", "payload": "{}",
            "logs": json.dumps({"events": [{"contract": "nft", "event": "transfer",
                                            "data": {"from": a, "to": b, "symbol": "S", "id": i}}]})}
           for i, (a, b) in enumerate(events)]
    return json.dumps({"blockNumber": n, "timestamp": ts, "transactions": txs})


def _land(spark, root, name, docs):
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.text(f"{root}/landing/{name}")


def _run(spark, root, sinks_dir, cp, **kw):
    q = capture.start_capture(spark, f"{root}/landing/*", sinks_dir, checkpoint=cp, max_files_per_trigger=1, **kw)
    q.awaitTermination()


def test_replay_adds_nothing_and_margin_holds_head(spark):
    root = tempfile.mkdtemp(prefix="cap-")
    _land(spark, root, "a", [_doc(1, [("a", "b")]), _doc(2, [("b", "c"), ("c", "d")])])
    _land(spark, root, "b", [_doc(3, [("d", "e")]), _doc(4, [("e", "f")])])
    _run(spark, root, f"{root}/sinks", f"{root}/cp1")
    ev = spark.read.parquet(f"{root}/sinks/nft_events")
    assert sorted((r.he_block, r.tx_seq) for r in ev.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0)]
    # a second run from a fresh checkpoint replays everything: no new rows
    _run(spark, root, f"{root}/sinks", f"{root}/cp2")
    assert spark.read.parquet(f"{root}/sinks/nft_events").count() == 4
    scopes = spark.read.parquet(f"{root}/sinks/touch_scopes")
    assert scopes.count() == scopes.dropDuplicates(["he_block", "account", "symbol"]).count()
    from mintlens.operators.views import capture_freshness
    assert capture_freshness(spark.read.parquet(f"{root}/sinks/pipeline_state")).first().last_live_block == 3


def test_block_landed_twice_in_one_batch(spark):
    root = tempfile.mkdtemp(prefix="cap-")
    d = _doc(7, [("a", "b"), ("b", "c")])
    _land(spark, root, "a", [d, d, _doc(8, [("x", "y")])])
    _run(spark, root, f"{root}/sinks", f"{root}/cp", margin=0)
    ev = spark.read.parquet(f"{root}/sinks/nft_events")
    assert sorted((r.he_block, r.tx_seq) for r in ev.collect()) == [(7, 0), (7, 1), (8, 0)]


def test_starting_block_and_backfill_mode(spark):
    root = tempfile.mkdtemp(prefix="cap-")
    _land(spark, root, "a", [_doc(10, [("a", "b")]), _doc(11, [("b", "c")]), _doc(12, [("c", "d")])])
    _run(spark, root, f"{root}/live", f"{root}/cp", starting_block=11, margin=0)
    assert sorted(r.he_block for r in spark.read.parquet(f"{root}/live/nft_events").collect()) == [11, 12]
    blocks = capture.read_blocks(spark, f"{root}/landing/a")
    capture.backfill(spark, blocks, f"{root}/bf")
    assert spark.read.parquet(f"{root}/bf/nft_events").count() == 3
    assert sinks.read_if_exists(spark, f"{root}/bf/touch_scopes") is None
    from mintlens.operators.views import backfill_cursor
    assert backfill_cursor(spark.read.parquet(f"{root}/bf/pipeline_state")).first()[0] == 10


def test_append_idempotent_keeps_smallest_duplicate(spark):
    path = tempfile.mkdtemp(prefix="sink-") + "/s"
    df = spark.createDataFrame([("S", 1, 10, 5.0, "x"), ("S", 1, 10, 3.0, "y"), ("S", 2, 10, 1.0, "z")],
                               "symbol string, nft_id bigint, he_block bigint, price double, seller string")
    key = ["symbol", "nft_id", "he_block"]
    sinks.append_idempotent(spark, df, path, key, order=["price", "seller"], range_col="he_block")
    sinks.append_idempotent(spark, df, path, key, order=["price", "seller"], range_col="he_block")
    got = sorted((r.nft_id, r.price, r.seller) for r in spark.read.parquet(path).collect())
    assert got == [(1, 3.0, "y"), (2, 1.0, "z")]


def test_write_view_replaces_only_given_partitions(spark):
    path = tempfile.mkdtemp(prefix="view-") + "/v"
    sinks.write_view(spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, nft_id bigint"), path, ["symbol"])
    sinks.write_view(spark.createDataFrame([("A", 9)], "symbol string, nft_id bigint"), path, ["symbol"])
    assert sorted((r.symbol, r.nft_id) for r in spark.read.parquet(path).collect()) == [("A", 9), ("B", 2)]


def test_drop_partitions_by_value(spark):
    path = tempfile.mkdtemp(prefix="ret-") + "/e"
    df = spark.createDataFrame([(3, 1), (4, 2)], "bucket bigint, x int")
    df.write.partitionBy("bucket").parquet(path)
    assert sinks.drop_partitions(spark, path, "bucket", ["3", "9"]) == ["bucket=3"]
    assert [r.x for r in spark.read.parquet(path).collect()] == [2]


def test_to_json_view_formats(spark):
    df = spark.createDataFrame([("7", "2026-07-10 00:00:00")], "p string, t string").select(
        F.col("p").cast("decimal(38,18)").alias("price"), F.col("t").cast("timestamp").alias("ts"))
    doc = json.loads(sinks.to_json_view(df).first().json)
    assert doc == {"price": "7", "ts": "2026-07-10T00:00:00.000000Z"}


def test_to_json_view_nested(spark):
    df = spark.sql("""SELECT 'v' AS viewer,
        array(named_struct('nft_id', 1L, 'price', CAST('7.50' AS DECIMAL(38,18)),
                           'seen', CAST('2026-07-10 00:00:00' AS TIMESTAMP))) AS items,
        map('a', CAST('2' AS DECIMAL(38,18))) AS m""")
    doc = json.loads(sinks.to_json_view(df).first().json)
    assert doc == {"viewer": "v", "items": [{"nft_id": 1, "price": "7.5", "seen": "2026-07-10T00:00:00.000000Z"}],
                   "m": {"a": "2"}}


def test_run_backfill_walks_down_and_resumes(spark):
    root = tempfile.mkdtemp(prefix="bf-")
    _land(spark, root, "a", [_doc(n, [("a", "b")]) for n in range(1, 11)])
    sink = f"{root}/sink"
    assert capture.run_backfill(spark, f"{root}/landing/a", sink, target=6, chunk_blocks=2, start_below=11) == 6
    assert sorted(r.he_block for r in spark.read.parquet(f"{sink}/nft_events").collect()) == [6, 7, 8, 9, 10]
    # resume from the recorded cursor
    assert capture.run_backfill(spark, f"{root}/landing/a", sink, target=1, chunk_blocks=3) == 1
    assert sorted(r.he_block for r in spark.read.parquet(f"{sink}/nft_events").collect()) == list(range(1, 11))


def test_capture_from_a_stream_of_documents(spark):
    root = tempfile.mkdtemp(prefix="cap-")
    _land(spark, root, "a", [_doc(1, [("a", "b")]), _doc(2, [("b", "c")])])
    docs = spark.readStream.schema("value string").text(f"{root}/landing/a")
    with pytest.raises(ValueError):
        capture.start_capture(spark, docs, f"{root}/sinks")
    docs = docs.withColumn("ingest_ts", F.lit("2026-07-01 00:00:00").cast("timestamp"))
    q = capture.start_capture(spark, docs, f"{root}/sinks", checkpoint=f"{root}/cp", margin=0)
    q.awaitTermination()
    assert spark.read.parquet(f"{root}/sinks/nft_events").count() == 2


def test_retain_sink_drops_buckets_whose_newest_row_is_old(spark):
    path = tempfile.mkdtemp(prefix="ret-") + "/e"
    rows = [(1, "2026-05-01 00:00:00", 1), (2, "2026-05-01 00:00:00", 2), (2, "2026-06-20 00:00:00", 3)]
    spark.createDataFrame(rows, "bucket bigint, t string, x int").selectExpr("bucket", "CAST(t AS timestamp) AS ts", "x").write.partitionBy(
        "bucket").parquet(path)
    assert capture.retain_sink(spark, path, "2026-07-10 00:00:00", days=30) == ["bucket=1"]
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3]


def test_sinks_feed_the_downstream_operators(spark):
    from mintlens.operators import state, views
    root = tempfile.mkdtemp(prefix="e2e-")
    sell = {"contract": "nftmarket", "action": "sell", "sender": "al", "transactionId": "s1", "payload": "{}",
            "logs": json.dumps({"events": [{"contract": "nftmarket", "event": "sellOrder",
                                            "data": {"account": "al", "symbol": "S", "nftId": "1", "price": "2"}}]})}
    doc2 = json.loads(_doc(2, [("al", "bo")]))
    doc2["transactions"].append(sell)
    _land(spark, root, "a", [_doc(1, [("bo", "cy")]), json.dumps(doc2), _doc(3, [("cy", "al")])])
    _run(spark, root, f"{root}/sinks", f"{root}/cp", margin=0)
    sink = lambda n: spark.read.parquet(f"{root}/sinks/{n}")
    tracked = spark.createDataFrame([("al",), ("bo",)], "account string")
    no_fetch = spark.createDataFrame([], "account string, symbol string, ok boolean, fetched_at timestamp")
    pending = state.pending_scopes(sink("touch_scopes"), no_fetch, tracked, "2030-01-01")
    assert sorted((r.account, r.symbol) for r in pending.collect()) == [("al", "S"), ("bo", "S")]
    books = spark.createDataFrame([], "symbol string, ok boolean, fetched_at timestamp")
    assert [r.symbol for r in state.dirty_symbols(sink("market_flags"), books).collect()] == ["S"]
    feed = views.account_activity(sink("nft_events"), "al", limit=10).collect()
    assert [(r.he_block, r.op) for r in feed] == [(3, "transfer"), (2, "market_list"), (2, "transfer")]
    cov = views.activity_coverage(sink("nft_events")).first()
    assert (cov.backfill_cursor_block, cov.backfill_complete) == (None, False)
    cov = views.activity_coverage(sink("nft_events"), backfill_cursor=1).first()
    assert (cov.backfill_cursor_block, cov.backfill_complete) == (1, True)
