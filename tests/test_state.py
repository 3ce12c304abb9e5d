"""Snapshots, books, floors, sales and retries on small frames made up here: each test states its rule as a table of cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mintlens.operators import market, state
from mintlens.schemas import HOLDING_RAW_DDL, ORDER_RAW_DDL
from mintlens.sources.snapshots import normalize_holdings, normalize_orders

HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
OUT = "account string, symbol string, ok boolean, fetched_at timestamp"


def at(hour):
    return dt.datetime(2025, 11, 3) + dt.timedelta(hours=hour)


def held(spark, *rows):
    """``rows``: (item, owner, hour of the fetch), all of one collection."""
    return spark.createDataFrame([("LYNX", item, owner, "u", None, "{}", at(hour)) for item, owner, hour in rows], HOLD)


def landed(spark, ddl, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "doc string").select(F.from_json("doc", ddl).alias("r")).select("r.*")


# what a fetch of piet's items at hour 8 does to (item, owner, hour), by what it found and whether it succeeded
@pytest.mark.parametrize("before,found,ok,after", [
    ([(40, "piet", 2), (41, "piet", 3)], [], True, []),                                     # nothing is left
    ([(40, "piet", 2), (41, "piet", 3)], [], False, [(40, "piet"), (41, "piet")]),          # unknown, so all stays
    ([(40, "piet", 2), (41, "piet", 3)], [(41, "piet", 8), (42, "piet", 8)], True, [(41, "piet"), (42, "piet")]),
    ([(40, "rosa", 2)], [(40, "piet", 8)], True, [(40, "piet")]),                           # it has changed hands
    ([(40, "rosa", 9)], [(40, "piet", 8)], True, [(40, "rosa")]),                           # rosa's fetch is newer
    ([(40, "rosa", 8)], [(40, "piet", 8)], True, [(40, "piet")]),                           # equal times: what was fetched
    ([(40, "rosa", 2), (41, "rosa", 2)], [(41, "piet", 8)], False, [(40, "rosa"), (41, "rosa")]),
    ([(40, "piet", 11)], [], True, [(40, "piet")])])                                        # seen after the fetch
def test_fetch_of_one_account(spark, before, found, ok, after):
    out = state.apply_holdings(held(spark, *before), held(spark, *found), spark.createDataFrame([("piet", "LYNX", ok, at(8))], OUT))
    assert sorted((r.nft_id, r.account) for r in out.collect()) == after


@pytest.mark.parametrize("record,want", [
    ({"delegatedTo": {"account": "rosa", "ownedBy": "c"}}, ("u", "rosa", "c", False)),
    ({"delegatedTo": "rosa", "ownedBy": "c"}, ("c", "rosa", None, False)),
    ({"soulBound": 1}, ("u", None, None, True)), ({}, ("u", None, None, False))])
def test_holding_records(spark, record, want):
    rows = normalize_holdings(landed(spark, HOLDING_RAW_DDL, {"symbol": "LYNX", "_id": "0077", "account": "piet", **record}))
    assert [(r.owned_by, r.delegated_to, r.delegated_to_type, r.soul_bound) for r in rows.collect()] == [want]
    assert rows.first().nft_id == 77


def test_floors_of_groups_and_tokens(spark):
    kinds = [None, {}, {"wing": "left"}, {"wing": "right", "age": 3}]
    records = [{"symbol": "LYNX", "nftId": k, "account": "rosa", "price": str(100 - k), "priceSymbol": "ORE" if k % 2 else "TIN",
                "timestamp": 1000 * k, "grouping": kinds[k % 4]} for k in range(24)]
    floors = {(r.price_symbol, r.grouping_key): (float(r.floor_price), r.open_orders)
              for r in market.market_floor(normalize_orders(landed(spark, ORDER_RAW_DDL, *records))).collect()}
    # k % 4: 0 and 1 are ungrouped, in different tokens; the dearest index is the cheapest order
    assert floors == {("TIN", "{}"): (80.0, 6), ("ORE", "{}"): (79.0, 6), ("TIN", '{"wing":"left"}'): (78.0, 6),
                      ("ORE", '{"age":3,"wing":"right"}'): (77.0, 6)}


def test_book_snapshots(spark):
    book = "symbol string, nft_id bigint, price double, pos bigint"
    cur = spark.createDataFrame([(s, k, 9.0) for s in ("LYNX", "MOTH", "NEWT") for k in (1, 2)], "symbol string, nft_id bigint, price double")
    new = spark.createDataFrame([("LYNX", 3, 4.0, 1), ("LYNX", 3, 3.0, 2), ("LYNX", 2, 5.0, 0), ("MOTH", 8, 1.0, 0), ("NEWT", 8, 1.0, 0)], book)
    outcomes = spark.createDataFrame([("LYNX", True, True, at(1)), ("MOTH", False, True, at(1)), ("NEWT", True, False, at(1))],
                                     "symbol string, ok boolean, complete boolean, fetched_at timestamp")
    after = state.apply_book(cur, new, outcomes)
    assert sorted((r.symbol, r.nft_id, r.price) for r in after.collect()) == [
        ("LYNX", 2, 5.0), ("LYNX", 3, 4.0), ("MOTH", 1, 9.0), ("MOTH", 2, 9.0), ("NEWT", 1, 9.0), ("NEWT", 2, 9.0)]


@pytest.mark.parametrize("fails,wait_s", [(1, 60), (2, 120), (5, 960), (9, 15360), (10, 21600), (30, 21600)])
def test_back_off_doubles_to_its_cap(spark, fails, wait_s):
    outs = [("piet", "LYNX", True, at(0))] + [("piet", "LYNX", False, at(1 + k)) for k in range(fails)]
    touches = spark.createDataFrame([], "account string, symbol string, touched_at timestamp")
    row, = state.pending_scopes(touches, spark.createDataFrame(outs, OUT), spark.createDataFrame([("piet",)], "account string"), at(99)).collect()
    assert (row.attempts, row.not_before - at(fails)) == (fails, dt.timedelta(seconds=wait_s))


def test_last_sale_and_volume(spark):
    # (item, price, block, hour): the last by time, then block, then item, then price; 30 days are 720 hours
    sales = [(1, 2.0, 5, 700), (2, 8.0, 6, 700), (3, 4.0, 6, 700), (3, 4.5, 6, 700), (9, 99.0, 1, 10), (9, 50.0, 9, 900), (5, 1.0, 2, 30)]
    rows = [("LYNX", n, p, "ORE", b, at(h)) for n, p, b, h in sales]
    df = spark.createDataFrame(rows, "symbol string, nft_id bigint, price double, price_symbol string, he_block bigint, ts timestamp")
    r, = market.market_last_sales(df, at(750)).collect()       # hour 30 is exactly 720 hours before: outside
    assert (r.last_price, r.last_ts, r.sales_30d, r.volume_30d) == (4.5, at(700), 4, 18.5)
