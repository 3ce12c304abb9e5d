"""What capture keeps between batches: held blocks, the start block, captured runs, quarantines, and compaction."""

import json
import os
import random

import pytest

from mintlens.operators import state
from mintlens.sources import sinks
from mintlens.streaming import capture

DOCS = "value string, ingest_ts timestamp"


def doc(n, price=None, **more):
    data = {"account": "ann", "symbol": "OAK", "id": n} | ({"price": price} if price else {})
    logs = {"events": [{"contract": "nftmarket", "event": "sellOrder", "data": data}]}
    return json.dumps({"blockNumber": n, "timestamp": "2026-02-03", "transactions": [
        {"contract": "nftmarket", "action": "sell", "sender": "ann", "transactionId": f"t{n}", "payload": {}, "logs": logs}], **more})


def batch(spark, *docs):
    return spark.createDataFrame([(d, None) for d in docs], DOCS)


def numbers(spark, root, sink="nft_events"):
    found = sinks.read_if_exists(spark, f"{root}/{sink}")
    return [] if found is None else sorted(r.he_block for r in found.collect())


def test_held_blocks_outlive_batch_numbers(spark, tmp_path):
    root = str(tmp_path)
    for epoch, blocks in ((0, (1, 2, 3)), (7, (4,)), (0, (5, 6)), (0, (7,))):
        capture.BlockCapture(root, margin=2)(batch(spark, *map(doc, blocks)), epoch)
    assert numbers(spark, root) == [1, 2, 3, 4, 5]
    assert sorted(r.blockNumber for r in capture.BlockCapture(root).held(spark).collect()) == [6, 7]
    capture.BlockCapture(root, margin=2)(batch(spark), 9)       # an empty batch keeps them
    assert sorted(r.blockNumber for r in capture.BlockCapture(root).held(spark).collect()) == [6, 7]
    assert len(sinks.partition_values(spark, f"{root}/held", "run")) == 1


def test_two_held_runs_after_a_crash(spark, tmp_path):
    """The new run was written, the old one not yet removed: nothing is lost or doubled."""
    root = str(tmp_path)
    body = capture.BlockCapture(root)
    body(batch(spark, doc(1), doc(2)), 0)
    spark.read.parquet(f"{root}/held/run=0").write.parquet(f"{root}/held/run=5")
    body(batch(spark, doc(3)), 1)
    assert numbers(spark, root) == [1, 2]
    assert [r.blockNumber for r in body.held(spark).collect()] == [3]


def test_copies_that_differ_give_one_block_whatever_the_order(spark, tmp_path):
    a, b = doc(4), doc(4, price="3")
    kept = set()
    for k, docs in enumerate(([a, b, a], [b, a], [b, b, a, doc(5)])):
        capture.BlockCapture(f"{tmp_path}/{k}", margin=0)(batch(spark, *docs), 0)
        rows = spark.read.parquet(f"{tmp_path}/{k}/nft_events").where("he_block = 4").collect()
        assert len(rows) == 1
        kept.add(rows[0].price)
    assert len(kept) == 1


def test_start_at_the_settled_tip(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        capture.BlockCapture(root, starting_block="genesis")
    capture.BlockCapture(root, starting_block=capture.TIP)(batch(spark), 0)      # nothing has landed: nothing is fixed
    capture.BlockCapture(root, starting_block=capture.TIP)(batch(spark, *map(doc, range(1, 11))), 1)
    capture.BlockCapture(root, starting_block=capture.TIP)(batch(spark, *map(doc, range(5, 14))), 0)
    assert numbers(spark, root) == [9, 10, 11, 12]


def test_overflowing_price_is_kept_as_text(spark, tmp_path):
    root = str(tmp_path)
    for epoch in (0, 1):
        capture.BlockCapture(root, margin=0)(batch(spark, doc(1, price="1e23"), doc(2, price="5"), doc(3, price="cheap")), epoch)
    assert numbers(spark, root) == [1, 2, 3]
    rows = spark.read.parquet(f"{root}/price_quarantine").collect()
    assert sorted((r.he_block, r.price_raw) for r in rows) == [(1, "1e23"), (3, "cheap")]


def test_usable_documents_are_not_quarantined(spark, tmp_path):
    root = str(tmp_path)
    twice = doc(1)[:-1] + ',"tag":1,"tag":2}'
    capture.BlockCapture(root, margin=0)(batch(spark, twice, '{"blockNumber":2,', "", "  "), 0)
    assert numbers(spark, root) == [1]
    assert [r.raw for r in spark.read.parquet(f"{root}/block_quarantine").collect()] == ['{"blockNumber":2,']


def test_backfill_keeps_bad_documents(spark, tmp_path):
    root = str(tmp_path)
    bad = ['{"blockNumber":3,', '{"tag":4}', "[5]"]
    spark.createDataFrame([(d,) for d in [*map(doc, range(1, 7)), *bad, bad[0]]], "value string").write.text(f"{root}/landing")
    capture.run_backfill(spark, f"{root}/landing", f"{root}/sink", target=1, chunk_blocks=2, start_below=6)
    assert numbers(spark, f"{root}/sink") == [1, 2, 3, 4, 5]
    assert sorted(r.raw for r in spark.read.parquet(f"{root}/sink/block_quarantine").collect()) == sorted(bad)


def test_captured_runs_give_the_gaps(spark, tmp_path):
    rng, path = random.Random(6), f"{tmp_path}/runs"
    from mintlens.plans.jobs import update_block_runs
    have = set()
    for _ in range(4):
        some = [rng.randint(0, 400) for _ in range(150)]
        have |= set(some)
        for _ in range(2):
            update_block_runs(spark, path, spark.createDataFrame([(n,) for n in some], "he_block bigint"), bucket_blocks=50)
        lo, hi = rng.randint(0, 60), rng.randint(300, 420)
        runs = spark.read.parquet(path)
        gaps = sorted(r.he_block for r in state.gap_blocks(state.gap_runs(runs, lo, hi)).collect())
        assert gaps == [n for n in range(lo, hi + 1) if n not in have]
        assert runs.agg({"hi": "max"}).first()[0] == max(have)
    assert [tuple(r) for r in state.gap_runs(runs.limit(0), 3, 9).collect()] == [(3, 9)]


def test_compaction_keeps_rows_and_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/s"
    for k in range(5):
        spark.createDataFrame([(1, k), (2, k)] if k < 2 else [(1, k)], "bucket int, x int").write.mode("append").partitionBy("bucket").parquet(path)
    files = lambda b: sorted(n for n in os.listdir(f"{path}/bucket={b}") if n.endswith(".parquet"))
    before = files(2)
    assert len(files(1)) == 5
    assert sinks.compact(spark, path, "bucket", files_at_most=3) == ["1"]
    rows = spark.read.parquet(path)
    assert sorted((r.bucket, r.x) for r in rows.collect()) == [(1, k) for k in range(5)] + [(2, 0), (2, 1)]
    assert len(files(1)) == 1 and files(2) == before


def test_a_sink_gets_a_file_a_bucket_whatever_the_number_of_tasks(spark, tmp_path):
    text = ['{"blockNumber":%d,"timestamp":"2024-01-01T00:00:00","transactions":[{"contract":"nft","action":"issue","sender":"a",'
            '"transactionId":"t%d","payload":"{}","logs":"{\\"events\\":[{\\"contract\\":\\"nft\\",\\"event\\":\\"issue\\",'
            '\\"data\\":{\\"account\\":\\"a\\",\\"symbol\\":\\"S\\",\\"id\\":\\"%d\\"}}]}"}]}' % (n, n, n) for n in range(80)]
    docs = spark.createDataFrame([(t,) for t in text], "value string").repartition(16)
    capture.BlockCapture(f"{tmp_path}", mode="backfill", bucket_blocks=20)(docs, 0)
    names = [n for _, _, some in os.walk(f"{tmp_path}/nft_events") for n in some if n.endswith(".parquet")]
    assert len(names) == 4
    assert sorted(r.he_block for r in spark.read.parquet(f"{tmp_path}/nft_events").collect()) == list(range(80))


def test_bad_documents_of_many_tasks_leave_a_file_a_part(spark, tmp_path):
    docs = spark.createDataFrame([("[%d]" % n,) for n in range(400)], "value string").repartition(16)
    capture.BlockCapture(f"{tmp_path}")(docs, 0)
    names = [n for _, _, some in os.walk(f"{tmp_path}/block_quarantine") for n in some if n.endswith(".parquet")]
    sink = spark.read.parquet(f"{tmp_path}/block_quarantine")
    assert len(names) == sink.select("part").distinct().count() <= capture.QUARANTINE_BUCKETS
    assert sink.select("raw").distinct().count() == sink.count() == 400


def test_small_buckets_of_a_day_share_a_folder(spark, tmp_path):
    from mintlens.plans.jobs import update_block_runs
    path, size = f"{tmp_path}/runs", state.BLOCKS_PER_DAY
    have = [n for n in range(size - 400, size + 300) if n % 97 != 5]
    for k in range(2):
        some = spark.createDataFrame([(n,) for n in have if k or n % 2], "he_block bigint")
        assert update_block_runs(spark, path, some, bucket_blocks=100) == [0, 1]
    assert sorted(n for n in os.listdir(path) if n.startswith("bucket=")) == ["bucket=0", "bucket=1"]
    runs = spark.read.parquet(path)
    assert all(r.lo // 100 == r.hi // 100 and r.bucket == r.lo // size for r in runs.collect())
    gaps = state.gap_blocks(state.gap_runs(runs, have[0], have[-1]))
    assert sorted(r.he_block for r in gaps.collect()) == [n for n in range(have[0], have[-1]) if n % 97 == 5]
