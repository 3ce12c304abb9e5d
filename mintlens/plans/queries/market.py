"""Market analytics queries: floors (E1/E2) and last sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...operators import market
from ...sources import fixtures as fx
from .common import SALES_AS_OF, comparable, register


# -- E1 / E2 ----------------------------------------------------------------

@register("market_floor", fx.with_fixtures("""
SELECT symbol, price_symbol, grouping_key, CAST(MIN(price) AS DOUBLE) AS floor_price, COUNT(*) AS open_orders
FROM fx_orders GROUP BY symbol, price_symbol, grouping_key""", "fx_orders"))
def q_market_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.fx_orders(spark, sf_dir).withColumnRenamed("grouping_key", "grouping")
    return comparable(market.market_floor(orders))


# -- E3 ----------------------------------------------------------------------

@register("market_last_sales", fx.with_fixtures(f"""
SELECT symbol, price_symbol,
       CAST(arg_max(price, (ts, he_block, nft_id, price)) AS DOUBLE) AS last_price,
       MAX(ts) AS last_ts,
       COUNT(*) FILTER (WHERE ts > TIMESTAMP '{SALES_AS_OF}' - INTERVAL 30 DAY) AS sales_30d,
       CAST(SUM(price) FILTER (WHERE ts > TIMESTAMP '{SALES_AS_OF}' - INTERVAL 30 DAY) AS DOUBLE) AS volume_30d
FROM fx_sales WHERE ts <= TIMESTAMP '{SALES_AS_OF}' GROUP BY symbol, price_symbol""", "fx_sales"))
def q_market_last_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(market.market_last_sales(fx.fx_sales(spark, sf_dir), SALES_AS_OF))
