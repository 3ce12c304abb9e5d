"""One rule for a confirmed fetch everywhere, records of one fetch only, replay into the sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mintlens.functions import grouping_key
from mintlens.operators import state
from mintlens.sources import sinks
from mintlens.sources.snapshots import normalize_holdings, normalize_orders, read_book_snapshots, read_holding_snapshots
from mintlens.streaming import capture

T0 = dt.datetime(2027, 1, 1)
HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
OUT = "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp"


def at(h):
    return T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("fetches,kept", [
    ([(1, True, True)], {2}), ([(1, False, True)], {1}), ([(1, True, False)], {1}), ([(1, True, None)], {2}),
    ([(1, True, True), (2, False, None)], {2}), ([(1, True, True), (2, True, False)], {2}), ([], {1})])
def test_holdings_and_open_work_follow_the_same_fetches(spark, fetches, kept):
    cur = spark.createDataFrame([("OAK", 1, "kim", "u", None, "{}", T0)], HOLD)
    fetched = spark.createDataFrame([("OAK", 2, "kim", "u", None, "{}", None)], HOLD)
    outcomes = spark.createDataFrame([("kim", "OAK", ok, full, at(h)) for h, ok, full in fetches], OUT)
    assert {r.nft_id for r in state.apply_holdings(cur, fetched, outcomes).collect()} == kept
    touched = spark.createDataFrame([("kim", "OAK", T0)], "account string, symbol string, touched_at timestamp")
    tracked = spark.createDataFrame([("kim",)], "account string")
    pending = state.pending_scopes(touched, outcomes, tracked, at(9)).collect()
    failed_last = bool(fetches) and not (fetches[-1][1] and fetches[-1][2] is not False)
    assert bool(pending) == (kept == {1} or failed_last)


def land(spark, tmp_path, records, outcomes):
    for name, rows in (("records", records), ("outcomes", outcomes)):
        spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(str(tmp_path / name))
    return str(tmp_path / "records"), str(tmp_path / "outcomes")


def test_two_fetches_of_a_scope_are_not_mixed(spark, tmp_path):
    first, second = "2027-01-01T01:00:00Z", "2027-01-01T02:00:00Z"
    rec = lambda n, t: {"symbol": "OAK", "_id": n, "account": "kim", "fetchedAt": t}
    paths = land(spark, tmp_path, [rec(1, first), rec(2, first), rec(1, second)],
                 [{"account": "kim", "symbol": "OAK", "ok": True, "complete": True, "fetched_at": t} for t in (first, second)])
    raw, outcomes = read_holding_snapshots(spark, *paths)
    fetched = normalize_holdings(raw, keep=("fetched_at",)).withColumn("refreshed_at", F.lit(None).cast("timestamp"))
    cur = spark.createDataFrame([], HOLD)
    assert [(r.nft_id, str(r.refreshed_at)) for r in state.apply_holdings(cur, fetched, outcomes).collect()] == [(1, "2027-01-01 02:00:00")]


def test_two_books_are_not_mixed_and_the_first_record_wins(spark, tmp_path):
    first, second = "2027-01-01T01:00:00Z", "2027-01-01T02:00:00Z"
    rec = lambda n, price, pos, t: {"symbol": "OAK", "nftId": n, "account": "kim", "price": price, "priceSymbol": "GOLD",
                                    "pos": pos, "fetchedAt": t}
    paths = land(spark, tmp_path, [rec(1, "1", 0, first), rec(2, "1", 1, first), rec(1, "9", 1, second), rec(1, "7", 0, second)],
                 [{"symbol": "OAK", "ok": True, "complete": True, "fetched_at": t} for t in (first, second)])
    raw, outcomes = read_book_snapshots(spark, *paths)
    orders = normalize_orders(raw, keep=("pos", "fetched_at"))
    cur = spark.createDataFrame([], "symbol string, nft_id bigint, account string, price decimal(38,18)")
    assert [(r.nft_id, float(r.price)) for r in state.apply_book(cur, orders, outcomes).collect()] == [(1, 7.0)]


def sale_block(number, sales, **more):
    data = {"symbol": "OAK", "account": "buyer", "priceSymbol": "GOLD", "sellers": [{"account": "kim", "nftSales": sales}]}
    logs = {"events": [{"contract": "nftmarket", "event": "hitSellOrder", "data": data}]}
    return json.dumps({"blockNumber": number, **more, "transactions": [
        {"contract": "nftmarket", "action": "buy", "sender": "buyer", "transactionId": "t", "payload": "{}", "logs": logs}]})


def test_redelivery_adds_nothing_and_the_first_sale_counts(spark, tmp_path):
    docs = spark.createDataFrame([(sale_block(5, [{"id": 1, "price": "9"}, {"id": 1, "price": "2"}]),), (sale_block(60_000, [{"id": 1, "price": "4"}]),),
                                  ("{broken",), ("{broken",)], "value string")
    for epoch, day in enumerate(("2027-01-01", "2027-01-05", "2027-01-05")):
        capture.BlockCapture(str(tmp_path), margin=0)(docs.withColumn("ingest_ts", F.lit(day).cast("timestamp")), epoch)
    sink = lambda n: spark.read.parquet(str(tmp_path / n))
    assert sorted((r.he_block, float(r.price), str(r.ts)) for r in sink("market_sales").collect()) == [
        (5, 9.0, "2027-01-01 00:00:00"), (60_000, 4.0, "2027-01-01 00:00:00")]
    assert sink("nft_events").count() == 3
    assert [(r.raw, r.reason) for r in sink("block_quarantine").collect()] == [("{broken", "not a JSON object")]
    assert sorted(p.name for p in (tmp_path / "market_sales").iterdir() if p.is_dir()) == ["bucket=0", "bucket=2"]


def test_only_a_missing_sink_counts_as_empty(spark, tmp_path):
    assert sinks.read_if_exists(spark, str(tmp_path / "none")) is None
    (tmp_path / "made").mkdir()
    assert sinks.read_if_exists(spark, str(tmp_path / "made")) is None
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        sinks.read_if_exists(spark, "nosuchscheme://x/y")


def test_copies_of_a_block_resolve_alike_on_every_run(spark, tmp_path):
    docs = [(sale_block(7, [{"id": 1, "price": p}]),) for p in ("1", "2", "3")]
    seen = set()
    for k in range(3):
        df = spark.createDataFrame(docs[k:] + docs[:k], "value string").repartition(3).withColumn("ingest_ts", F.lit("2027-01-01").cast("timestamp"))
        capture.BlockCapture(str(tmp_path / str(k)), margin=0)(df, 0)
        seen |= {float(r.price) for r in spark.read.parquet(str(tmp_path / str(k) / "market_sales")).collect()}
    assert len(seen) == 1


@pytest.mark.parametrize("text,want", [
    ('{"b":1,"a":"1"}', '{"a":"1","b":1}'), ('{"a":1}', '{"a":1}'), ('{"a":{"y":1,"x":[2]}}', '{"a":{"x":[2],"y":1}}'), ("{}", "{}"),
    (None, "{}"), ("oops", "{}"), ("[1]", "{}"), ("3", "{}"), ('{"a":null}', '{"a":null}')])
def test_group_keys_are_canonical_and_typed(spark, text, want):
    assert spark.createDataFrame([(text,)], "g string").select(grouping_key("g").alias("k")).first().k == want
