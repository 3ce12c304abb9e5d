"""Stored forms of the market figures and feeds, kept up to date by the parts that changed.

* **Floors** (E1), a partition a symbol: recomputed for the symbols whose book was replaced; the rest is not read.
* **Sales tiles** (E3), a partition a month: count, sum and last sale of a day per (symbol, token). The trailing window adds
  whole days up and reads single sales of its two edge days only. Retention drops months.
* **Feeds** (F4), by week of blocks and bucket of the viewer: a page of one account reads one bucket of each week.
* **Items** (D3, D4): holdings and orders as tables bucketed alike by (symbol, nft_id); their join needs no exchange.

Partition lists handled on the driver are bounded by the catalog (symbols) or the calendar (days).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market, views
from ..operators.market import as_ts
from ..operators.pages import page_params, parse_activity_cursor
from ..session import checkpoint_dir
from ..sources.sinks import append_idempotent, drop_partitions, partition_values, write_view

FEED_BUCKETS = 256
FEED_BLOCKS = 28800 * 7         # blocks of a feed folder: a week
ITEM_BUCKETS = 256


# -- E1 ------------------------------------------------------------------------

def refresh_floors(spark: SparkSession, path: str, book: DataFrame, symbols: list[str] | None = None) -> list[str]:
    """E1 kept: floors of ``symbols`` (what ``apply_book_table`` returns) from the stored ``book``, whose other partitions
    are not read; ``None`` is the backstop sweep over all. Symbols without an order left lose their partition."""
    if symbols is not None:
        if not symbols:
            return []
        book = book.where(F.col("symbol").isin(symbols))
    floors = market.market_floor(book).persist()
    found = [r.symbol for r in floors.select("symbol").distinct().collect()]        # one a collection at most
    if found:
        write_view(floors.repartition("symbol"), path, ["symbol"])
    floors.unpersist()
    known = partition_values(spark, path, "symbol") if symbols is None else symbols
    drop_partitions(spark, path, "symbol", [s for s in known if s not in found])
    return found


# -- E3 ------------------------------------------------------------------------

TILE_KEYS = ["symbol", "price_symbol"]


def sales_tiles(sales: DataFrame, in_window: Column | None = None) -> DataFrame:
    """(symbol, price_symbol, day, n, volume, last_price, last_ts): the sales of a day; n and volume of those ``in_window``."""
    counted = F.lit(True) if in_window is None else in_window
    order = F.struct("ts", "he_block", "nft_id", "price")
    return (sales.groupBy(*TILE_KEYS, F.to_date("ts").alias("day"))
            .agg(F.count_if(counted).alias("n"), F.try_sum(F.when(counted, F.col("price"))).alias("volume"),
                 F.max_by("price", order).alias("last_price"), F.max("ts").alias("last_ts")))


def update_sales_tiles(spark: SparkSession, path: str, sales: DataFrame, days: list[dt.date]) -> None:
    """E3 kept: the months of ``days`` (those for which sales were captured) are computed again from the sales of these months
    (the bounds on ``ts`` reach the scan), so a sale that comes late or twice counts once, like in the log."""
    if not days:
        return
    months = sorted({d.replace(day=1) for d in days})
    after = (months[-1] + dt.timedelta(days=31)).replace(day=1)
    hit = F.trunc("ts", "month").isin(months) & (F.col("ts") >= F.lit(months[0]).cast("timestamp")) & (
        F.col("ts") < F.lit(after).cast("timestamp"))
    tiles = sales_tiles(sales.where(hit)).withColumn("month", F.trunc("day", "month"))
    write_view(tiles.repartition("month"), path, ["month"])


def last_sales_from_tiles(tiles: DataFrame, sales: DataFrame, as_of, days: int = 30) -> DataFrame:
    """E3 from tiles; equal to :func:`market.market_last_sales` over ``sales``, of which only the two days that the window's
    ends lie in are read. Days are added up by a hash aggregate, which also finds each pair's last day; its tile has the
    last sale."""
    t = as_ts(as_of)
    start = t - F.expr(f"INTERVAL {int(days)} DAYS")
    first, last = F.to_date(start), F.to_date(t)
    tiles = tiles.where(F.col("month") <= last) if "month" in tiles.columns else tiles
    whole = tiles.where((F.col("day") < last) & (F.col("day") != first))
    inside = F.col("day") > first
    whole = whole.select(*TILE_KEYS, "day", F.when(inside, F.col("n")).otherwise(0).alias("n"),
                         F.when(inside, F.col("volume")).alias("volume"), "last_price", "last_ts")
    edge = sales.where((F.col("ts") <= t) & (((F.col("ts") >= first.cast("timestamp")) & (F.to_date("ts") == first))
                                             | ((F.col("ts") >= last.cast("timestamp")) & (F.to_date("ts") == last))))
    every = whole.unionByName(sales_tiles(edge, F.col("ts") > start))
    lost = F.count_if((F.col("n") > 0) & F.col("volume").isNull()) > 0      # a day's sum has overflowed: so has the total
    sums = every.groupBy(*TILE_KEYS).agg(
        F.max("day").alias("day"), F.sum("n").alias("sales_30d"),
        F.when(~lost, F.try_sum("volume")).alias("volume_30d"))
    return (sums.join(every.select(*TILE_KEYS, "day", "last_price", "last_ts"), [*TILE_KEYS, "day"])
            .select(*TILE_KEYS, "last_price", "last_ts", "sales_30d", "volume_30d"))


def retain_tiles(spark: SparkSession, path: str, as_of, days: int) -> list[str]:
    """Drops the tiles of months that ended before ``as_of`` less ``days``."""
    t = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    oldest = (t - dt.timedelta(days=int(days))).date()
    old = [m for m in partition_values(spark, path, "month") if dt.date.fromisoformat(m) < oldest.replace(day=1)]
    return drop_partitions(spark, path, "month", old)


# -- F4 ------------------------------------------------------------------------

def _viewer_bucket(viewer: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(viewer), F.lit(int(buckets))).cast("int")


def _week() -> Column:
    return F.floor(F.col("he_block") / FEED_BLOCKS).cast("int")


def append_feeds(spark: SparkSession, path: str, events: DataFrame, buckets: int = FEED_BUCKETS) -> None:
    """F4 kept: the feed rows of new events, by (week of blocks, bucket of the viewer), newest first in a file. Rows that are
    there already are left out, so a replay adds nothing; only the weeks of the new rows are read for that. The rows of a
    hot account lie in one bucket, but eight tasks a week write them."""
    rows = views.feed_rows(events).withColumn("bucket", _viewer_bucket(F.col("viewer"), buckets)).withColumn("week", _week())
    weeks = [r.week for r in rows.select("week").distinct().collect()]      # of the new rows

    def arrange(df: DataFrame) -> DataFrame:
        spread = df.repartition("week", "bucket", F.floor(F.col("he_block") / (FEED_BLOCKS // 8)))
        return spread.sortWithinPartitions("week", "bucket", "viewer", F.desc("he_block"), F.desc("tx_seq"))

    append_idempotent(spark, rows, path, ["viewer", "he_block", "tx_seq"], partition_by=["week", "bucket"], buckets=weeks, arrange=arrange)


def account_feed(spark: SparkSession, path: str, account: str, cursor: str | tuple[int, int] | None = None,
                 limit: int = 100, buckets: int = FEED_BUCKETS) -> DataFrame:
    """F4 for one account from the stored feeds: one bucket is read, and below a cursor only its weeks up to the cursor's."""
    _, n = page_params(0, limit)
    mine = int(spark.range(1).select(_viewer_bucket(F.lit(account), buckets)).first()[0])
    rows = spark.read.parquet(path).where((F.col("bucket") == mine) & (F.col("viewer") == account))
    if cursor:
        block, seq = parse_activity_cursor(cursor)
        rows = rows.where(F.col("week") <= block // FEED_BLOCKS).where(views.below(F.lit(block), F.lit(seq)))
    return rows.orderBy(F.col("he_block").desc(), F.col("tx_seq").desc()).limit(n).drop("bucket", "week", "viewer")


# -- D3 / D4 --------------------------------------------------------------------

def write_items(df: DataFrame, name: str, path: str, buckets: int = ITEM_BUCKETS) -> DataFrame:
    """Holdings or orders as the table ``name`` at ``path``, bucketed and sorted by (symbol, nft_id). Two tables with equal
    ``buckets`` join on these columns without an exchange."""
    checkpoint_dir(df.sparkSession)
    keys = ("symbol", "nft_id")
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)      # one file a bucket
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)
