"""Stored figures against the direct queries, and what their plans read."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from mintlens.operators import market, views
from mintlens.plans import rollups

ORDER = "symbol string, nft_id bigint, price decimal(38,18), price_symbol string, grouping_key string"
SALE = "symbol string, nft_id bigint, price decimal(38,18), price_symbol string, he_block bigint, ts timestamp"
EVENT = ("he_block bigint, tx_seq int, symbol string, nft_id bigint, op string, account string, counterparty string, "
         "price decimal(38,18), price_symbol string, tx_id string, ts timestamp")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_floors_follow_the_book_and_leave_other_symbols(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    book = {(s, k): (Decimal(rng.randint(1, 50)), rng.choice("XY"), rng.choice(["{}", '{"a":1}'])) for s in "ABCD" for k in range(20)}

    def stored():
        return spark.createDataFrame([(s, k, *v) for (s, k), v in book.items()], ORDER)

    def check():
        want = market.market_floor(stored()).collect()
        got = spark.read.parquet(f"{path}/f").select(want[0].__fields__).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))

    rollups.refresh_floors(spark, f"{path}/f", stored())
    check()
    for dirty in (["A"], ["B", "C"], ["D"], ["A", "D"]):
        before = files(f"{path}/f")
        for s in dirty:
            for k in range(20):
                book.pop((s, k), None)
                if s != "D" and rng.random() < 0.7:
                    book[s, k] = (Decimal(rng.randint(1, 50)), "X", "{}")
        assert set(rollups.refresh_floors(spark, f"{path}/f", stored(), dirty)) == set(dirty) - {"D"}
        check()
        assert {f.split(os.sep)[-2] for f in before - files(f"{path}/f")} <= {f"symbol={s}" for s in dirty}
    book.clear()
    book["E", 1] = (Decimal(3), "X", "{}")
    rollups.refresh_floors(spark, f"{path}/f", stored())        # the sweep drops what is gone
    check()
    assert rollups.refresh_floors(spark, f"{path}/f", stored(), []) == []


def test_last_sales_from_tiles_equal_the_direct_query(spark, tmp_path):
    rng, path, t0 = random.Random(5), str(tmp_path), dt.datetime(2026, 1, 1)
    rows = [(rng.choice("AB"), rng.randint(1, 3), Decimal(rng.randint(1, 9)), rng.choice("XY"), rng.randint(1, 50),
             t0 + dt.timedelta(hours=rng.choice([rng.randint(0, 24 * 70), 24 * 30, 24 * 40]))) for _ in range(400)]
    rows += [("C", 1, Decimal("9" * 20), "X", k, t0 + dt.timedelta(days=k)) for k in range(12)]     # sums overflow
    sales = spark.createDataFrame(rows, SALE)
    seen = []
    for k in range(3):      # sales come in any order; the days that they hit are tiled again
        seen += rows[k::3]
        days = sorted({r[5].date() for r in rows[k::3]})
        rollups.update_sales_tiles(spark, f"{path}/t", spark.createDataFrame(seen, SALE), days)
    tiles = spark.read.parquet(f"{path}/t")
    for hours in (24 * 70, 24 * 45, 24 * 45 + 7, 24 * 30, 24 * 5 + 1, 0, -5):
        at = t0 + dt.timedelta(hours=hours)
        want = market.market_last_sales(sales, at)
        got = rollups.last_sales_from_tiles(tiles, sales, at).select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = plan_of(rollups.last_sales_from_tiles(tiles, spark.read.parquet(f"{path}/t").limit(0).select(
        "symbol", F.lit(1).cast("long").alias("nft_id"), F.col("last_price").alias("price"), "price_symbol", F.lit(1).cast("long").alias("he_block"),
        F.col("last_ts").alias("ts")), t0))
    assert re.search(r"HashAggregate\(keys=\[symbol#\d+, price_symbol#\d+\]", plan)


def test_tiles_are_retained_by_month(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [("A", 1, Decimal(1), "X", k, dt.datetime(2026, k, 3)) for k in range(1, 10)]
    rollups.update_sales_tiles(spark, path, spark.createDataFrame(rows, SALE), [r[5].date() for r in rows])
    assert len(rollups.retain_tiles(spark, path, "2026-08-02 12:00:00", 30)) == 6
    assert sorted(str(r.day) for r in spark.read.parquet(path).collect()) == [f"2026-0{k}-03" for k in range(7, 10)]


def test_feed_of_one_account_reads_one_bucket(spark, tmp_path):
    rng, path = random.Random(9), str(tmp_path)
    names = [f"n{k}" for k in range(12)]
    rows = {(b, s): (b, s, "S", 1, "burn", rng.choice([*names, "hot", "hot", None]), rng.choice([*names, None, "hot"]), None, None, "t", None)
            for b in [rng.randint(0, rollups.FEED_BLOCKS * 3) for _ in range(150)] for s in range(2)}
    events = spark.createDataFrame(list(rows.values()), EVENT)
    for part in (events.where("he_block % 2 = 0"), events):
        rollups.append_feeds(spark, path, part, buckets=4)
    head = max(rows)[0]
    for who in ("hot", "n3", "nobody"):
        for cursor in (None, (head // 2, 1), f"{head}:0"):
            want = views.account_activity(events, who, cursor=cursor, limit=20).collect()
            got = rollups.account_feed(spark, path, who, cursor=cursor, limit=20, buckets=4)
            assert [(r.he_block, r.tx_seq) for r in got.collect()] == [(r.he_block, r.tx_seq) for r in want]
    plan = plan_of(rollups.account_feed(spark, path, "hot", cursor=(head // 2, 1), buckets=4))
    assert re.search(r"PartitionFilters: \[[^\]]*week#\d+ <= \d+[^\]]*bucket#\d+ = \d", plan) or re.search(
        r"PartitionFilters: \[[^\]]*bucket#\d+ = \d[^\]]*week#\d+ <= \d", plan), plan
    assert "EqualTo(viewer,hot)" in plan


def test_bucketed_items_join_without_an_exchange(spark, tmp_path):
    hold = spark.createDataFrame([("A", k, f"a{k % 3}", "u", None, "{}") for k in range(50)],
                                 "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string")
    orders = spark.createDataFrame([("A", k, "a1", Decimal(k), "X", None) for k in range(0, 50, 2)],
                                   "symbol string, nft_id bigint, account string, price decimal(38,18), price_symbol string, ts timestamp")
    none = spark.createDataFrame([], "symbol string, name string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = rollups.write_items(hold, "kept_holdings", f"{tmp_path}/h", buckets=4)
        o = rollups.write_items(orders, "kept_orders", f"{tmp_path}/o", buckets=4)
        listed = views.wallet_sections(h, o, none).where("section = 'listed'")
        plan = plan_of(h.join(o.select("symbol", "nft_id", "price"), ["symbol", "nft_id"]))
        assert "SortMergeJoin" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
        assert not re.search(r"Exchange hashpartitioning\(symbol#\d+, nft_id#\d+L", plan_of(listed))
        assert not re.search(r"Exchange hashpartitioning\(symbol#\d+, nft_id#\d+L", plan_of(views.nft_detail(h, none, o)))
        assert listed.count() == 25 and views.nft_detail(h, none, o).where("open_order is not null").count() == 25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS kept_holdings")
        spark.sql("DROP TABLE IF EXISTS kept_orders")
