"""Plan properties the design relies on, checked on the physical plans."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from mintlens.operators import parse as P
from mintlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_parse_is_map_only(spark):
    docs = spark.createDataFrame([('{"blockNumber":1,"transactions":[]}',)], "value string")
    plan = plan_of(P.nft_events(P.parse_blocks(P.blocks_from_json(docs))))
    assert "Exchange" not in plan
    # no inferred size(events) > 0 filter re-evaluating the parse below the generator
    assert not re.search(r"Condition : .*size\(", plan)


def test_top_n_per_key_limits_before_the_shuffle(spark):
    for name in ("account_activity", "orders_page"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert re.search(r"WindowGroupLimit.*Partial", plan, re.S), name


def test_as_of_bound_reaches_the_scan(spark):
    plan = plan_of(QUERIES["market_last_sales"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(l_shipdate", plan)


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(QUERIES["market_floor"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas and all("o_comment" not in s and "o_clerk" not in s for s in schemas)
    assert any(s.count(":") <= 6 for s in schemas)


def test_dimensions_are_broadcast_after_a_check(spark):
    plan = plan_of(QUERIES["display_object"](spark, SF))
    assert "BroadcastHashJoin" in plan


def test_no_product_of_frames_anywhere(spark):
    for name in ("pipeline_status", "refresh_plan", "wallet_view", "account_state", "pending_scopes"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_sink_idempotency_check_reads_only_its_buckets(spark, tmp_path):
    from mintlens.sources import sinks
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(b * 100, 1, b) for b in range(6)], "he_block bigint, tx_seq int, bucket bigint")
    df.write.partitionBy("bucket").parquet(path)
    some = sinks.read_buckets(spark, path, "bucket", [2, 3], df.schema)
    assert {f.rsplit("/", 2)[-2] for f in some.inputFiles()} == {"bucket=2", "bucket=3"}
    assert sorted(r.he_block for r in some.collect()) == [200, 300]
    assert sinks.read_buckets(spark, path, "bucket", range(8, 10), df.schema) is None
    assert sinks.read_buckets(spark, path + "-none", "bucket", range(10), df.schema) is None


def test_table_job_reads_only_refreshed_symbol_partitions(spark, tmp_path):
    import datetime as dt
    from mintlens.plans.jobs import apply_holdings_table, write_holdings
    hold = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
    t0 = dt.datetime(2026, 7, 1)
    path = str(tmp_path / "h")
    write_holdings(spark.createDataFrame([("A", 1, "a", "u", None, "{}", t0), ("B", 2, "b", "u", None, "{}", t0)], hold), path)
    fetched = spark.createDataFrame([("A", 3, "a", "u", None, "{}", t0 + dt.timedelta(days=1))], hold)
    outcomes = spark.createDataFrame([("a", "A", True, t0 + dt.timedelta(days=1))],
                                     "account string, symbol string, ok boolean, fetched_at timestamp")
    assert {s for s, _ in apply_holdings_table(spark, path, fetched, outcomes)} == {"A"}
    got = sorted((r.symbol, r.nft_id) for r in spark.read.parquet(path).collect())
    assert got == [("A", 3), ("B", 2)]
    plan = plan_of(spark.read.parquet(path).where(F.col("symbol").isin(["A"])))
    assert re.search(r"PartitionFilters: \[[^\]]*symbol", plan), plan


def test_table_job_removes_a_symbol_emptied_by_the_refresh(spark, tmp_path):
    import datetime as dt
    from mintlens.plans.jobs import apply_book_table, apply_holdings_table, write_holdings
    hold = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
    t0 = dt.datetime(2026, 7, 1)
    path = str(tmp_path / "h")
    write_holdings(spark.createDataFrame([("A", 1, "a", "u", None, "{}", t0), ("B", 2, "b", "u", None, "{}", t0)], hold), path)
    outcomes = spark.createDataFrame([("a", "A", True, t0 + dt.timedelta(days=1))],
                                     "account string, symbol string, ok boolean, fetched_at timestamp")
    apply_holdings_table(spark, path, spark.createDataFrame([], hold), outcomes)
    assert [(r.symbol, r.nft_id) for r in spark.read.parquet(path).collect()] == [("B", 2)]
    book = str(tmp_path / "o")
    spark.createDataFrame([("A", 1, 5.0), ("B", 2, 6.0)], "symbol string, nft_id bigint, price double") \
        .write.partitionBy("symbol").parquet(book)
    outc = spark.createDataFrame([("B", True, True, t0)], "symbol string, ok boolean, complete boolean, fetched_at timestamp")
    apply_book_table(spark, book, spark.createDataFrame([], "symbol string, nft_id bigint, price double, pos bigint"), outc)
    assert [(r.symbol, r.nft_id) for r in spark.read.parquet(book).collect()] == [("A", 1)]


def test_hot_escrow_account_is_split_into_bounded_groups(spark):
    from mintlens.operators import views
    from mintlens.sources import fixtures as fx
    sf = "/root/testdata/sf0.01"
    h = fx.fx_holdings(spark, sf)
    share = h.where("account = 'market'").count() / h.count()
    assert share > 0.3  # the escrow account holds about a third of all rows
    pages = views.wallet_pages(views.wallet_sections(h, fx.fx_orders(spark, sf), fx.fx_collections(spark, sf)))
    biggest = pages.select(F.max(F.size("items"))).first()[0]
    assert biggest <= views.WALLET_ID_RANGE
    assert pages.where("viewer = 'market'").select(F.sum(F.size("items"))).first()[0] == h.where("account = 'market'").count()
