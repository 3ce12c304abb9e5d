"""Open work and account state: refresh plans, dirty books, due accounts, account clock, catalog."""

import datetime as dt

import pytest

from mintlens.operators import state

HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
T0 = dt.datetime(2026, 7, 1)


@pytest.mark.parametrize("queued,populated,holds,want", [
    (["OAK"], True, ["OAK", "ELM"], {("targeted", "OAK")}),
    (["OAK", "FIR"], True, [], {("targeted", "OAK"), ("targeted", "FIR")}),
    ([""], True, ["ELM"], {("held", "ELM")}),
    (["", "FIR"], True, ["ELM"], {("held", "ELM"), ("held", "FIR")}),
    ([""], True, [], {("full", None)}),
    (["OAK"], False, ["ELM"], {("full", None)}),
    (["", "OAK"], False, [], {("full", None)})])
def test_refresh_plan(spark, queued, populated, holds, want):
    due = spark.createDataFrame([("kim", queued)], "account string, syms array<string>")
    known = spark.createDataFrame([("kim", T0 if populated else None)], "account string, populated_at timestamp")
    held = spark.createDataFrame([(sym, n, "kim", "u", None, "{}", T0) for n, sym in enumerate(holds)], HOLD)
    assert {(r.mode, r.symbol) for r in state.refresh_plan(due, held, known).collect()} == want


def test_items_delegated_to_an_account_are_held_by_both(spark):
    held = spark.createDataFrame([("OAK", 3, "lender", "u", "user", "{}", T0), ("ELM", 4, "lender", "u", None, "{}", T0)], HOLD)
    assert sorted(tuple(r) for r in state.held_symbols(held).collect()) == [("lender", "ELM"), ("lender", "OAK"), ("user", "OAK")]


@pytest.mark.parametrize("flags,snapshots,dirty", [
    ([5], [], True), ([5], [(4, True, True)], True), ([5], [(6, True, True)], False), ([5, 7], [(6, True, True)], True),
    ([5], [(6, False, True)], True), ([5], [(6, True, False)], True), ([5], [(6, True, None)], False),
    ([5], [(6, True, True), (8, False, None)], False)])
def test_dirty_until_a_confirmed_book_is_newer(spark, flags, snapshots, dirty):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    ev = spark.createDataFrame([("OAK", "market_list", at(m)) for m in flags] + [("ELM", "burn", at(1))], "symbol string, op string, ts timestamp")
    books = spark.createDataFrame([("OAK", ok, full, at(m)) for m, ok, full in snapshots],
                                  "symbol string, ok boolean, complete boolean, fetched_at timestamp")
    assert [r.symbol for r in state.dirty_symbols(ev, books).collect()] == (["OAK"] if dirty else [])


def test_due_accounts_oldest_first_and_not_before(spark):
    p = spark.createDataFrame([
        ("a", "S", T0 + dt.timedelta(minutes=5), 0, T0 + dt.timedelta(minutes=5)),
        ("a", "T", T0 + dt.timedelta(minutes=1), 0, T0 + dt.timedelta(minutes=1)),
        ("b", "S", T0, 2, T0 + dt.timedelta(hours=5)),
        ("c", "", T0 + dt.timedelta(minutes=3), 0, T0 + dt.timedelta(minutes=3))],
        "account string, symbol string, queued_at timestamp, attempts bigint, not_before timestamp")
    got = [(r.account, list(r.syms)) for r in state.due_accounts(p, T0 + dt.timedelta(hours=1), 5).collect()]
    assert got == [("a", ["S", "T"]), ("c", [""])]
    assert [r.account for r in state.due_accounts(p, T0 + dt.timedelta(hours=1), 1).collect()] == ["a"]


def test_account_state_absent_tracked_populated_stale(spark):
    acc = spark.createDataFrame([("p", T0, T0), ("t", T0, None), ("s", T0 - dt.timedelta(days=1), T0)],
                                "account string, refreshed_at timestamp, populated_at timestamp")
    req = spark.createDataFrame([("p",), ("t",), ("s",), ("x",), ("nftmarket",)], "account string")
    got = {r.account: (r.state, r.stale) for r in
           state.account_state(acc, T0 + dt.timedelta(hours=1), requested=req, escrow="nftmarket").collect()}
    assert got == {"p": ("populated", False), "t": ("tracked", False), "s": ("populated", True),
                   "x": ("absent", False), "nftmarket": ("tracked", False)}


def test_upsert_catalog_keeps_missing_and_latest_record_wins(spark):
    cur = spark.createDataFrame([("A", "old a"), ("B", "old b")], "symbol string, name string")
    snap = spark.createDataFrame([("A", "a1", 1), ("A", "a2", 2), ("C", "c", 1)], "symbol string, name string, pos bigint")
    got = sorted((r.symbol, r.name) for r in state.upsert_catalog(cur, snap).collect())
    assert got == [("A", "a2"), ("B", "old b"), ("C", "c")]


def test_only_full_passes_move_the_clock(spark):
    acc = spark.createDataFrame([("a", T0, T0, None)],
                                "account string, first_seen_at timestamp, refreshed_at timestamp, populated_at timestamp")
    out = spark.createDataFrame([("a", "CARD", True, T0 + dt.timedelta(days=2)), ("a", "", True, T0 + dt.timedelta(days=1)),
                                 ("b", "", False, T0 + dt.timedelta(days=1))],
                                "account string, symbol string, ok boolean, fetched_at timestamp")
    got = {r.account: (r.refreshed_at, r.populated_at) for r in state.apply_account_passes(acc, out).collect()}
    assert got == {"a": (T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1))}


def test_known_symbols_exists_arm(spark):
    c = spark.createDataFrame([("EMPTY", 0), ("LIVE", 5), ("UNKNOWN", None), ("BURNT", 0)],
                              "symbol string, circulating_supply bigint")
    h = spark.createDataFrame([("BURNT", 1, "a", "u", None, "{}", T0)], HOLD)
    assert sorted(r.symbol for r in state.known_symbols(c, h).collect()) == ["BURNT", "LIVE", "UNKNOWN"]


def test_dirty_symbols_from_the_live_flag_sink(spark):
    flags = spark.createDataFrame([(10, "CARD", T0 + dt.timedelta(minutes=2)), (11, "CARD", T0)],
                                  "he_block bigint, symbol string, flagged_at timestamp")
    snaps = spark.createDataFrame([("CARD", True, T0 + dt.timedelta(minutes=1))], "symbol string, ok boolean, fetched_at timestamp")
    assert [r.flagged_at for r in state.dirty_symbols(flags, snaps).collect()] == [T0 + dt.timedelta(minutes=2)]
