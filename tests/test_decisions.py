"""Regression tests for the decisions of SURVEY §L that no other test pins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mintlens.operators import state, views

HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
T0 = dt.datetime(2026, 7, 1)


def test_L2_truncated_holdings_fetch_is_not_a_confirmed_result(spark):
    cur = spark.createDataFrame([("CARD", i, "esc", "c", None, "{}", T0) for i in range(3)], HOLD)
    fetched = spark.createDataFrame([("CARD", 0, "esc", "c", None, "{}", T0 + dt.timedelta(days=1))], HOLD)
    outcomes = spark.createDataFrame([("esc", "CARD", True, False, T0 + dt.timedelta(days=1))],
                                     "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp")
    assert state.apply_holdings(cur, fetched, outcomes).count() == 3


def test_L3_whole_account_refresh_covers_held_and_named(spark):
    due = spark.createDataFrame([("a", ["", "NEW"])], "account string, syms array<string>")
    hold = spark.createDataFrame([("OLD", 1, "a", "u", None, "{}", T0)], HOLD)
    acc = spark.createDataFrame([("a", T0)], "account string, populated_at timestamp")
    got = {(r.mode, r.symbol) for r in state.refresh_plan(due, hold, acc).collect()}
    assert got == {("held", "OLD"), ("held", "NEW")}


def test_L4_touch_during_fetch_stays_pending(spark):
    touches = spark.createDataFrame([("a", "S", T0 + dt.timedelta(minutes=5))], "account string, symbol string, touched_at timestamp")
    outc = spark.createDataFrame([("a", "S", True, T0)], "account string, symbol string, ok boolean, fetched_at timestamp")
    tracked = spark.createDataFrame([("a",)], "account string")
    assert state.pending_scopes(touches, outc, tracked, T0 + dt.timedelta(hours=1)).count() == 1
    later = spark.createDataFrame([("a", "S", True, T0 + dt.timedelta(minutes=10))], "account string, symbol string, ok boolean, fetched_at timestamp")
    assert state.pending_scopes(touches, outc.unionByName(later), tracked, T0 + dt.timedelta(hours=1)).count() == 0


def test_L4_untracked_touches_are_ignored(spark):
    touches = spark.createDataFrame([("z", "S", T0)], "account string, symbol string, touched_at timestamp")
    outc = spark.createDataFrame([], "account string, symbol string, ok boolean, fetched_at timestamp")
    tracked = spark.createDataFrame([("a",)], "account string")
    assert state.pending_scopes(touches, outc, tracked, T0 + dt.timedelta(hours=1)).count() == 0


def test_L13_cursor_is_a_pair_not_a_packed_number(spark):
    ev = spark.createDataFrame([(7, s, "a") for s in (0, 9999, 10000, 10001)] + [(8, 0, "a")],
                               "he_block bigint, tx_seq int, account string").withColumn("counterparty", F.lit(None).cast("string"))
    page = views.account_activity(ev, "a", cursor=(7, 10001), limit=10).collect()
    assert [(r.he_block, r.tx_seq) for r in page] == [(7, 10000), (7, 9999), (7, 0)]
    text = views.account_activity(ev, "a", cursor="8:0", limit=10).collect()
    assert [(r.he_block, r.tx_seq) for r in text][0] == (7, 10001)
    seen, cursors = [], None            # page after page in bulk: every row once, none again
    while True:
        got = views.activity_feeds(ev.withColumns({c: F.lit(None).cast("string") for c in (
            "symbol", "nft_id", "op", "price", "price_symbol", "tx_id", "ts")}), limit=2, cursors=cursors).orderBy("rank").collect()
        seen += [(r.he_block, r.tx_seq) for r in got]
        if not got or got[-1].next_cursor is None:
            break
        cursors = spark.createDataFrame([("a", got[-1].next_cursor)], "viewer string, cursor string")
    assert seen == [(8, 0), (7, 10001), (7, 10000), (7, 9999), (7, 0)]
    for bad in ("80000", "8:x", "8", 80000):
        with pytest.raises(ValueError):
            views.account_activity(ev, "a", cursor=bad)


def test_L12_settled_blocks_and_gaps(spark):
    b = spark.createDataFrame([(n,) for n in (1, 2, 4, 5, 9)], "he_block bigint")
    assert [r.he_block for r in state.block_gaps(spark, b, 1, 9).orderBy("he_block").collect()] == [3, 6, 7, 8]
    assert state.complete_through(state.block_gaps(spark, b, 1, 9), 9).first()[0] == 2
    assert [r.he_block for r in state.settled_blocks(b, head=5).collect()] == [1, 2, 4]
    assert state.backfill_target(1000) == 1 and state.backfill_target(10 ** 7) == 10 ** 7 - 30 * 28800
