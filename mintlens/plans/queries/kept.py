"""Stored figures kept up to date by what changed: floors (E1), last sales (E3), feeds (F4), bucketed items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import views
from ...sources import fixtures as fx
from .. import jobs, rollups
from .common import ORACLE, SALES_AS_OF, comparable, fresh_dir, register
from .read_views import FEED_PAGE
from .snapshots import book_fixture


@register("market_floor_kept", "SELECT symbol, price_symbol, grouping_key, MIN(price) AS floor_price, COUNT(*) AS open_orders FROM ("
          + ORACLE["apply_book"] + ") book GROUP BY symbol, price_symbol, grouping_key")
def q_market_floor_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors of a stored book, then new books for some symbols, after which only their floors are computed again."""
    path = fresh_dir(spark, "kept-floors")
    fx.fx_orders(spark, sf_dir).write.partitionBy("symbol").parquet(f"{path}/book")
    rollups.refresh_floors(spark, f"{path}/floors", spark.read.parquet(f"{path}/book"))
    replaced = jobs.apply_book_table(spark, f"{path}/book", *book_fixture(spark, sf_dir))
    rollups.refresh_floors(spark, f"{path}/floors", spark.read.parquet(f"{path}/book"), replaced)
    return comparable(spark.read.parquet(f"{path}/floors").select("symbol", "price_symbol", "grouping_key", "floor_price", "open_orders"))


TILE_TIMES = (SALES_AS_OF, "2000-03-10 17:30:00", "1996-02-29 23:59:59")


@register("market_last_sales_kept", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS as_of, q.* FROM (" + ORACLE["market_last_sales"].replace(SALES_AS_OF, t) + ") q" for t in TILE_TIMES))
def q_market_last_sales_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 at three times from daily tiles. The tiles were built from half of the sales and then, for the days on which
    the other half came, again."""
    path = fresh_dir(spark, "sales-tiles")
    sales = fx.fx_sales(spark, sf_dir)
    sales.write.parquet(f"{path}/sales")
    sales = spark.read.parquet(f"{path}/sales")
    half = sales.where(F.col("he_block") % 2 == 0)
    days = lambda df: [r.d for r in df.select(F.to_date("ts").alias("d")).distinct().collect()]
    rollups.update_sales_tiles(spark, f"{path}/tiles", half, days(half))
    rollups.update_sales_tiles(spark, f"{path}/tiles", sales, days(sales.where(F.col("he_block") % 2 == 1)))
    tiles = spark.read.schema("symbol string, price_symbol string, n bigint, volume decimal(38,18), last_price decimal(38,18), "
                              "last_ts timestamp, day date, month date").parquet(f"{path}/tiles")
    out = None
    for t in TILE_TIMES:
        at = rollups.last_sales_from_tiles(tiles, sales, dt.datetime.fromisoformat(t)).withColumn("as_of", F.lit(t))
        out = at if out is None else out.unionByName(at)
    return comparable(out)


@register("account_feed_kept", ORACLE["account_activity_one"])
def q_account_feed_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one account's page below a cursor from the stored feeds, which two appends have filled (the second brings the
    events of the first again)."""
    path, ev = fresh_dir(spark, "feeds"), fx.fx_events(spark, sf_dir)
    who, head = ev.agg(F.min("account"), F.max("he_block")).first()
    for part in (ev.where(F.col("he_block") % 3 == 0), ev):
        rollups.append_feeds(spark, path, part, buckets=8)
    feed = rollups.account_feed(spark, path, who, cursor=f"{head - 5}:4", limit=FEED_PAGE, buckets=8)
    return comparable(feed.select(*views.ACTIVITY_COLS))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = fresh_dir(spark, "items")
    name = path.rsplit("-", 1)[1]
    return tuple(rollups.write_items(df, f"{kind}_{name}", f"{path}/{kind}", buckets=8)
                 for kind, df in (("holdings", fx.fx_holdings(spark, sf_dir)), ("orders", fx.fx_orders(spark, sf_dir))))


@register("nft_detail_bucketed", ORACLE["nft_detail"])
def q_nft_detail_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 over tables bucketed by (symbol, nft_id): the join of items and orders has no exchange."""
    holdings, orders = _items(spark, sf_dir)
    d = views.nft_detail(holdings, fx.fx_collections(spark, sf_dir), orders)
    return d.select("symbol", "nft_id", "account", "collection_name", F.col("open_order").isNotNull().alias("has_open_order"),
                    F.col("open_order.price").cast("double").alias("order_price"),
                    F.col("open_order.price_symbol").alias("order_price_symbol"),
                    F.col("open_order.account").alias("order_account"), F.col("open_order.ts").alias("order_ts"))
