"""Block parsing by rule: every activity label, identity and price keys, encounter order, purchases, account
scans, scopes, unknown names, unusable documents. Documents are generated from small tables of fields."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mintlens.functions import block_ts
from mintlens.operators import parse as P

INGEST = "2031-03-04 05:06:07"


class Ledger:
    """A block under construction: ``add`` appends a transaction with some emitted events."""

    def __init__(self, number=7_000, when="2027-01-02T03:04:05"):
        self.doc = {"blockNumber": number, "timestamp": when, "transactions": []}

    def add(self, *events, contract="nft", action="do", sender="kim", payload=None, encoded=True):
        emitted = [{"contract": c, "event": name, "data": fields} for c, name, fields in events]
        logs = {"events": emitted}
        self.doc["transactions"].append({
            "contract": contract, "action": action, "sender": sender, "payload": json.dumps(payload or {}),
            "transactionId": f"id{len(self.doc['transactions'])}", "logs": json.dumps(logs) if encoded else logs})
        return self

    def blocks(self, spark):
        docs = spark.createDataFrame([(json.dumps(self.doc),)], "value string")
        return P.blocks_from_json(docs, ingest_ts=F.lit(INGEST).cast("timestamp"))

    def parsed(self, spark):
        return P.parse_blocks(self.blocks(spark))


def feed(spark, ledger):
    return P.nft_events(ledger.parsed(spark)).orderBy("tx_seq").collect()


def test_every_label(spark):
    ledger = Ledger()
    for k, name in enumerate(sorted(P.EVENT_OPS)):
        ledger.add(("nft", name, {"symbol": "OAK", "id": str(k), "account": f"a{k}", "to": f"b{k}"}), sender=f"s{k}")
    got = feed(spark, ledger)
    assert [(r.op, r.nft_id, r.account, r.counterparty) for r in got] == [
        (P.EVENT_OPS[name], k, f"a{k}", f"b{k}") for k, name in enumerate(sorted(P.EVENT_OPS))]
    assert [r.tx_seq for r in got] == list(range(len(P.EVENT_OPS)))


@pytest.mark.parametrize("fields,want", [
    ({"symbol": "OAK", "id": "12"}, 12),
    ({"symbol": "OAK", "id": 12}, 12),
    ({"symbol": "OAK", "nftId": "13"}, 13),
    ({"symbol": "OAK", "id": None, "nftId": "13"}, None),       # a key that is present wins, even when null
    ({"symbol": "OAK", "id": " 14 "}, 14),
    ({"symbol": "OAK", "id": "14.5"}, None),
    ({"symbol": "OAK", "id": "x14"}, None),
    ({"id": "15"}, None),
    ({}, None)])
def test_identity(spark, fields, want):
    got = feed(spark, Ledger().add(("nft", "burn", {"account": "a", **fields})))
    assert [r.nft_id for r in got] == ([] if want is None else [want])


@pytest.mark.parametrize("fields,want", [
    ({"price": "3.25", "newPrice": "9"}, 3.25), ({"newPrice": "9"}, 9.0), ({"price": None, "newPrice": "9"}, None),
    ({"price": "cheap"}, None), ({}, None)])
def test_price_keys(spark, fields, want):
    got, = feed(spark, Ledger().add(("nftmarket", "changePrice", {"symbol": "OAK", "id": 1, "account": "a", **fields}), contract="nftmarket"))
    assert (None if got.price is None else float(got.price)) == want


def test_actor_prefers_a_filled_from(spark):
    a, b = feed(spark, Ledger().add(("nft", "transfer", {"symbol": "OAK", "id": 1, "from": "giver", "account": "other", "to": "taker"}),
                                    ("nft", "transfer", {"symbol": "OAK", "id": 2, "from": "", "account": "other"})))
    assert (a.account, a.counterparty, b.account, b.counterparty) == ("giver", "taker", "other", None)


def test_only_item_contracts_count_but_any_transaction_may_emit_them(spark):
    ledger = (Ledger()
              .add(("bank", "transfer", {"symbol": "OAK", "id": 1, "from": "a", "to": "b"}), contract="bank")
              .add(("lottery", "win", {"symbol": "OAK", "id": 2}), ("nft", "issue", {"symbol": "OAK", "id": 3, "to": "w"}), contract="lottery")
              .add(("nft", "setGroupBy", {"symbol": "OAK", "id": 4}), contract="nft"))
    assert [r.nft_id for r in feed(spark, ledger)] == [3]
    assert sorted(r.tx_id for r in P.nft_activity(ledger.blocks(spark)).collect()) == ["id1", "id2"]


def purchase(sellers, **fields):
    return ("nftmarket", "hitSellOrder", {"symbol": "OAK", "account": "buyer", "priceSymbol": "GOLD", "sellers": [
        {"account": who, "nftSales": sales} for who, sales in sellers], **fields})


def test_purchase_is_one_row_an_item_in_order(spark):
    sellers = [("u", [{"id": 9, "price": "1"}, {"id": "8", "price": "2", "symbol": "IRON"}]), ("v", [{"id": "7", "price": "0.5"}])]
    parsed = Ledger().add(purchase(sellers), contract="nftmarket", action="buy").parsed(spark)
    want = [(9, "u", "GOLD", 1.0), (8, "u", "IRON", 2.0), (7, "v", "GOLD", 0.5)]
    events = P.market_buys(parsed).orderBy("tx_seq").collect()
    assert [(r.nft_id, r.counterparty, r.price_symbol, float(r.price)) for r in events] == want
    sales = P.market_sales(parsed, with_pos=True).orderBy("sale_pos").collect()
    assert [(r.nft_id, r.seller, r.price_symbol, float(r.price)) for r in sales] == want
    assert {r.buyer for r in sales} == {"buyer"}


@pytest.mark.parametrize("contract,action,n", [("nftmarket", "buy", 1), ("nftmarket", "sell", 0), ("shop", "buy", 0)])
def test_sales_come_from_buy_transactions_of_the_market(spark, contract, action, n):
    parsed = Ledger().add(purchase([("u", [{"id": 1, "price": "1"}])]), contract=contract, action=action).parsed(spark)
    assert P.market_sales(parsed).count() == n and P.market_buys(parsed).count() == 1


def test_unsellable_rows_are_quarantined(spark):
    bad = [{"id": "one", "price": "1"}, {"id": 2, "price": "free"}, {"id": 3, "price": "1" + "0" * 40}]
    parsed = Ledger().add(purchase([("u", bad), (None, [{"id": 4, "price": "1"}])]), contract="nftmarket", action="buy").parsed(spark)
    assert P.market_sales(parsed).count() == 0
    assert sorted(str(r.id_raw) for r in P.sales_quarantine(parsed).collect()) == ["2", "3", "4", "one"]


def accounts(spark, ledger):
    return {r.account for r in P.touched_accounts(ledger.blocks(spark)).collect()}


def test_accounts_at_any_depth(spark):
    rng = random.Random(11)
    names, tree = [], {"leaf": 1}
    for depth in range(6):
        key = rng.choice(P.ACCOUNT_KEYS)
        names.append(f"who{depth}")
        tree = {key: names[-1], "more": [tree, {"note": "to"}], "amount": depth}
    assert accounts(spark, Ledger().add(("bank", "anything", tree), contract="nft", payload={"x": tree})) == {"kim", *names}


def test_account_values_are_unescaped_and_look_alikes_ignored(spark):
    odd = 'quote " slash \\ tab \t end'
    ledger = Ledger().add(contract="nft", payload={"to": odd, "memo": 'he said "from": "nobody"', "from": "", "issuer": 5})
    assert accounts(spark, ledger) == {"kim", odd}


@pytest.mark.parametrize("value", ["x" * 1_000_000, "\\" * 100_000, '"\\' * 50_000 + "z"])
def test_long_values_do_not_break_the_scan(spark, value):
    assert accounts(spark, Ledger().add(contract="nft", payload={"to": value, "from": "q"})) == {"kim", "q", value}


def test_broken_logs_and_payload_leave_the_sender(spark):
    ledger = Ledger().add(contract="nft")
    ledger.doc["transactions"][0].update(logs="{oops", payload='{"to": "cut')
    assert accounts(spark, ledger) == {"kim"}


def test_scopes_name_the_symbol_where_an_event_does(spark):
    ledger = Ledger().add(("nft", "transfer", {"symbol": "OAK", "id": 1, "from": "a", "to": "b"}), payload={"to": "c"}, sender="a")
    got = {(r.account, r.symbol) for r in P.touch_scopes(ledger.parsed(spark)).collect()}
    assert got == {("a", "OAK"), ("b", "OAK"), ("c", "")}


def test_names_outside_both_lists_raise_an_alarm(spark):
    ledger = Ledger(number=31).add(("nft", "fuse", {}), ("nft", "create", {}), ("bank", "fuse", {}), ("nft", "burn", {"symbol": "OAK", "id": 1}))
    ledger.add(("nftmarket", "fuse", {}))
    assert [tuple(r) for r in P.unknown_events(ledger.parsed(spark)).collect()] == [("fuse", 2, 31, 31)]


def test_logs_as_an_object(spark):
    got, = feed(spark, Ledger().add(("nft", "burn", {"symbol": "OAK", "id": 1, "account": "a"}), encoded=False))
    assert (got.op, got.he_block) == ("burn", 7_000)


@pytest.mark.parametrize("text,want", [
    ("2027-01-02T03:04:05", "2027-01-02 03:04:05"), ("2027-01-02T03:04:05Z", "2027-01-02 03:04:05"),
    ("2027-01-02T03:04:05+02:00", "2027-01-02 01:04:05"), ("2027-01-02", "2027-01-02 00:00:00"), (" 2027-01-02 03:04 ", "2027-01-02 03:04:00"),
    ("03:04:05", INGEST), ("2027", INGEST), ("2027-01", INGEST), ("yesterday", INGEST), ("", INGEST), (None, INGEST)])
def test_block_time(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert str(df.select(block_ts("t", F.lit(INGEST).cast("timestamp")).alias("x")).first().x) == want


def test_unusable_documents_keep_text_and_reason(spark):
    lines = ['{"blockNumber":1,"transactions":[]}', '{"blockNumber":"x"}', '{"transactions":[]}', "[1]", '{"blockNumber":2', "", "  ", "7"]
    got = {r.raw: r.reason for r in P.unusable_documents(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {'{"blockNumber":"x"}': "no block number", '{"transactions":[]}': "no block number", "[1]": "not a JSON object",
                   '{"blockNumber":2': "not a JSON object", "7": "not a JSON object"}
