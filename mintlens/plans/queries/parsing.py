"""Parser queries: block documents built from the events table and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import parse
from ...sources import fixtures as fx
from .common import comparable, register


# -- parser round trip: blocks built from fx_events, parsed back -------------

def fx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.fx_block_docs(spark, sf_dir)
    return parse.blocks_from_json(docs, ingest_ts=F.lit(fx.BLOCK_INGEST_TS).cast("timestamp"))


def fx_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_blocks(fx_blocks(spark, sf_dir))


# block time as the parser must see it: earliest event time, ingest time when missing
_EV = f"""ev AS (
  SELECT *, CASE WHEN he_block % 50 = 49 THEN TIMESTAMP '{fx.BLOCK_INGEST_TS}'
                 ELSE MIN(ts) OVER (PARTITION BY he_block) END AS bts
  FROM fx_events)"""


def ev_sql(body: str) -> str:
    return fx.with_fixtures(body, "fx_events").replace("\n)\n", "\n),\n" + _EV + "\n", 1)


@register("nft_events", ev_sql("""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, bts AS ts FROM ev"""))
def q_nft_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(parse.nft_events(fx_parsed(spark, sf_dir)))


@register("market_sales", ev_sql("""
SELECT symbol, nft_id, CAST(price AS DOUBLE) AS price, price_symbol, counterparty AS seller, account AS buyer,
       he_block, bts AS ts FROM ev WHERE op = 'market_buy'"""))
def q_market_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(parse.market_sales(fx_parsed(spark, sf_dir)))


@register("market_buys", ev_sql("""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, bts AS ts FROM ev WHERE op = 'market_buy'"""))
def q_market_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(parse.market_buys(fx_parsed(spark, sf_dir)))


@register("touch_scopes", ev_sql("""
SELECT DISTINCT he_block, account, symbol, bts AS touched_at FROM (
  SELECT he_block, account, symbol, bts FROM ev
  UNION ALL SELECT he_block, counterparty, symbol, bts FROM ev WHERE counterparty IS NOT NULL
  UNION ALL SELECT he_block, 'issuer' || CAST(he_block % 13 AS VARCHAR), '', bts FROM ev) t"""))
def q_touch_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.touch_scopes(fx_parsed(spark, sf_dir))


@register("touched_accounts", ev_sql("""
SELECT DISTINCT he_block, tx_pos, tx_id, account FROM (
  SELECT he_block, tx_seq + 1 AS tx_pos, tx_id, account FROM ev
  UNION ALL SELECT he_block, tx_seq + 1, tx_id, counterparty FROM ev WHERE counterparty IS NOT NULL
  UNION ALL SELECT he_block, 0, 'adm' || CAST(he_block AS VARCHAR), 'issuer' || CAST(he_block % 13 AS VARCHAR) FROM ev) t"""))
def q_touched_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.touched_accounts(fx_blocks(spark, sf_dir))


@register("unknown_events", ev_sql("""
SELECT 'updateRoyalty' AS event, COUNT(*) AS n, MIN(he_block) AS first_block, MAX(he_block) AS last_block
FROM (SELECT DISTINCT he_block FROM ev) b WHERE he_block % 7 = 0"""))
def q_unknown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.unknown_events(fx_parsed(spark, sf_dir))


_TX_SQL = """
  SELECT he_block, 0 AS tx_pos, 'adm' || CAST(he_block AS VARCHAR) AS tx_id, 'nft' AS contract, 'setProperties' AS action
  FROM (SELECT DISTINCT he_block FROM ev) a
  UNION ALL
  SELECT he_block, tx_seq + 1, tx_id,
         CASE WHEN op = 'issue' AND he_block % 2 = 0 THEN 'packmanager'
              WHEN op LIKE 'market%' THEN 'nftmarket' ELSE 'nft' END,
         CASE WHEN op = 'issue' AND he_block % 2 = 0 THEN 'open' WHEN op = 'market_buy' THEN 'buy'
              WHEN op = 'market_list' THEN 'sell' ELSE op END
  FROM ev"""


@register("nft_activity", ev_sql(f"SELECT * FROM ({_TX_SQL}) t"))
def q_nft_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nft_activity(fx_blocks(spark, sf_dir)).select("he_block", "tx_pos", "tx_id", "contract", "action")


@register("explode_tx", ev_sql(f"""
SELECT * FROM ({_TX_SQL}
  UNION ALL
  SELECT he_block, CAST(COUNT(*) + 1 AS INTEGER), 'tok' || CAST(he_block AS VARCHAR), 'tokens', 'transfer'
  FROM ev WHERE he_block % 2 = 1 GROUP BY he_block) t"""))
def q_explode_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.explode_tx(fx_blocks(spark, sf_dir)).select("he_block", "tx_pos", "tx_id", "contract", "action")


@register("block_ts", ev_sql("SELECT DISTINCT he_block, bts AS ts FROM ev"))
def q_block_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.typed_blocks(fx_blocks(spark, sf_dir)).select("he_block", "ts")
