"""Pages, feeds and wallet views on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mintlens.operators import pages, views

EV = "he_block bigint, tx_seq int, symbol string, nft_id bigint, op string, account string, counterparty string, " \
     "price decimal(38,18), price_symbol string, tx_id string, ts timestamp"


def test_page_params():
    assert pages.page_params(None, None) == (0, 100)
    assert pages.page_params("5", "5000") == (5, 1000)
    assert pages.page_params(0, 0) == (0, 1)
    with pytest.raises(ValueError):
        pages.page_params("x", 10)
    with pytest.raises(ValueError):
        pages.page_params(0, "ten")


def _events(spark):
    t = dt.datetime(2026, 7, 1)
    rows = [(b, s, "S", b, "transfer", "alice" if (b + s) % 2 else "bob", "carol" if s == 1 else None,
             None, None, f"t{b}{s}", t) for b in range(1, 6) for s in range(3)]
    return spark.createDataFrame(rows, EV)


def test_account_activity_cursor(spark):
    e = _events(spark)
    first = views.account_activity(e, "alice", limit=2).collect()
    assert [(r.he_block, r.tx_seq) for r in first] == [(5, 2), (5, 0)]
    cur = (first[-1].he_block, first[-1].tx_seq)
    nxt = views.account_activity(e, "alice", cursor=cur, limit=2).collect()
    assert [(r.he_block, r.tx_seq) for r in nxt] == [(4, 1), (3, 2)]
    as_cpty = views.account_activity(e, "carol", limit=100).collect()
    assert len(as_cpty) == 5


def test_activity_feeds_dedupe_and_rank(spark):
    e = _events(spark).withColumn("counterparty", F.when(F.col("tx_seq") == 0, F.col("account")))
    f = views.activity_feeds(e, limit=3)
    got = {}
    for r in f.collect():
        got.setdefault(r.viewer, []).append((r.rank, r.he_block, r.tx_seq))
    for v in got.values():
        assert [x[0] for x in sorted(v)] == [1, 2, 3]
    # self-counterparty rows are not duplicated
    assert f.groupBy("viewer", "he_block", "tx_seq").count().where("count > 1").count() == 0


def test_collections_page_cursor(spark):
    c = spark.createDataFrame([(f"S{i:02d}", f"n{i}", 10, 4) for i in range(5)],
                              "symbol string, name string, supply bigint, circulating_supply bigint")
    m = spark.createDataFrame([("S01", 1, "{}")], "symbol string, version int, mapping string")
    p1 = views.collections_page(c, m, "", 2).collect()
    assert [r.symbol for r in p1] == ["S00", "S01"] and pages.next_cursor(p1, "symbol", 2) == "S01"
    assert [r.has_display_mapping for r in p1] == [False, True] and p1[0].burned == 6
    p3 = views.collections_page(c, m, "S03", 2).collect()
    assert [r.symbol for r in p3] == ["S04"] and pages.next_cursor(p3, "symbol", 2) is None


def test_wallet_sections_and_symbol_filter(spark):
    h = spark.createDataFrame([("A", 1, "alice", "u", None, "{}"), ("A", 2, "nftmarket", "c", None, "{}"),
                               ("B", 3, "dave", "u", "alice", "{}")],
                              "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string")
    o = spark.createDataFrame([("A", 2, "alice", 7.0, "BEE")], "symbol string, nft_id bigint, account string, price double, price_symbol string")
    c = spark.createDataFrame([("A", "Alpha")], "symbol string, name string")
    viewers = spark.createDataFrame([("alice",)], "account string")
    got = sorted((r.section, r.symbol, r.nft_id, r.account, r.collection_name)
                 for r in views.wallet_sections(h, o, c, viewers).collect())
    assert got == [("delegated_in", "B", 3, "dave", None), ("listed", "A", 2, "alice", "Alpha"),
                   ("owned", "A", 1, "alice", "Alpha")]
    only_b = views.wallet_sections(h, o, c, viewers, symbol="B").collect()
    assert [r.section for r in only_b] == ["delegated_in"]


def test_wallet_pages_bounded_groups(spark):
    items = spark.createDataFrame([("v", "owned", "S", i, "v") for i in range(0, 2500)],
                                  "viewer string, section string, symbol string, nft_id bigint, account string")
    pg = views.wallet_pages(items, id_range=1000).orderBy("id_range").collect()
    assert [len(r["items"]) for r in pg] == [1000, 1000, 500]
    assert [x.nft_id for x in pg[1]["items"]][:2] == [1000, 1001]
