"""Market analytics: floors (E1), canonical group key (E2), last sale and
trailing volume (E3), the order-book page (F3) and the market flag (C5).

Every aggregate here is a plain hash aggregate keyed by symbol/token(/group),
so Spark runs a partial (map-side) aggregate before the shuffle: a symbol or
token holding a third of all orders still ships one partial row per map task,
not its rows. Prices are never converted between payment tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grouping_key
from .pages import keyset_page


def as_ts(as_of) -> F.Column:
    """A literal ``as_of`` (text, datetime or Column) as a timestamp column."""
    return as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp")


def with_grouping_key(orders: DataFrame, grouping_col: str = "grouping") -> DataFrame:
    """Add the canonical text key of the JSON group (``{}`` when absent)."""
    if "grouping_key" in orders.columns:
        return orders
    return orders.withColumn("grouping_key", grouping_key(grouping_col))


def market_floor(orders: DataFrame) -> DataFrame:
    """Floor price and open-order count per (symbol, token, group).
    An ungrouped symbol (``{}``) collapses to one row per token."""
    o = with_grouping_key(orders)
    return (o.groupBy("symbol", "price_symbol", "grouping_key")
            .agg(F.min("price").alias("floor_price"), F.count(F.lit(1)).alias("open_orders")))


def market_last_sales(sales: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per (symbol, token): last price and time, and count / sum over the
    trailing window (as_of - days, as_of]. Sales after ``as_of`` are not yet
    known. Ties on time are broken by (he_block, nft_id, price) so the last
    sale is deterministic. Volume is NULL and count 0 when the window is empty."""
    t = as_ts(as_of)
    in_window = (F.col("ts") > t - F.expr(f"INTERVAL {int(days)} DAYS"))
    order_key = F.struct("ts", "he_block", "nft_id", "price")
    return (sales.where(F.col("ts") <= t)
            .groupBy("symbol", "price_symbol")
            .agg(F.max_by("price", order_key).alias("last_price"),
                 F.max("ts").alias("last_ts"),
                 F.count_if(in_window).alias("sales_30d"),
                 # try_sum: an overflowing DECIMAL(38,18) volume is NULL for that
                 # group instead of failing the whole job under ANSI mode
                 F.try_sum(F.when(in_window, F.col("price"))).alias("volume_30d")))


def orders_page(orders: DataFrame, symbol: str, cursor: int = 0, limit: int = 100,
                seller: str | None = None) -> DataFrame:
    """one symbol's open orders with nft_id > cursor, ascending, optionally
    one seller's only. The limit is the page size (the feature)."""
    o = orders.where(F.col("symbol") == symbol)
    if seller:
        o = o.where(F.col("account") == seller)
    return keyset_page(o, "nft_id", cursor, limit)


def derive_market_enabled(collections: DataFrame, orders: DataFrame) -> DataFrame:
    """``market_enabled`` is true iff the symbol has an open order; it is
    always derived from the book, never stored (an EXISTS, run as a left
    join against the distinct symbols of the book)."""
    listed = orders.select("symbol").distinct().withColumn("_listed", F.lit(True))
    base = collections.drop("market_enabled") if "market_enabled" in collections.columns else collections
    return (base.join(listed, "symbol", "left")
            .withColumn("market_enabled", F.coalesce(F.col("_listed"), F.lit(False)))
            .drop("_listed"))
