"""Documents whose writers escape, repeat and nest their keys: account walk (B12, B13), events (B8), group keys (E2),
display properties (G1, G2), and prices that no DECIMAL(38,18) holds (B8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import display, market, parse
from ...sources import fixtures as fx
from .common import comparable, register


def _text(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block an event. The payload nests the counterparty ``tx_seq`` levels deep under an escaped key, beside a repeated key and
    a look-alike inside a string; the event data repeats symbol, from and price, and the last of each counts."""
    e = fx.fx_events(spark, sf_dir).withColumn("id", F.col("he_block") * 10 + F.col("tx_seq"))
    named = F.concat(F.lit('{"memo":1,"memo":"say \\"to\\":\\"nobody\\",","\\u0074o": '), _text(F.coalesce("counterparty", F.lit(""))), F.lit("}"))
    payload = F.concat(F.repeat(F.lit('{"deep":[0,'), F.col("tx_seq")), named, F.repeat(F.lit("]}"), F.col("tx_seq")))
    price = F.when(F.col("id") % 9 == 4, F.lit('"1e23"')).otherwise(F.coalesce(F.col("price").cast("decimal(18,2)").cast("string"), F.lit("null")))
    data = F.concat(
        F.lit('{"symbol":"OLD","from":"ghost","price":7,"\\u0073ymbol":'), _text(F.col("symbol")), F.lit(',"price":'), price,
        F.lit(',"from":'), _text(F.col("account")), F.lit(',"id":'), F.col("nft_id").cast("string"), F.lit("}"))
    doc = F.concat(
        F.lit('{"blockNumber":'), F.col("id").cast("string"), F.lit(',"transactions":[],"transactions":[{"contract":"nft","sender":"s","transactionId":'),
        _text(F.col("tx_id")), F.lit(',"payload":'), payload, F.lit(',"logs":{"events":[{"contract":"nft","event":"transfer","data":'), data,
        F.lit("}]}}]}"))
    docs = e.select(doc.alias("value"))
    return parse.usable_blocks(docs, ingest_ts=F.lit(fx.BLOCK_INGEST_TS).cast("timestamp"))


_E = "(SELECT *, he_block * 10 + tx_seq AS id FROM fx_events) e"


@register("nested_accounts", fx.with_fixtures(f"""
SELECT id AS he_block, account FROM (
  SELECT id, 's' AS account FROM {_E}
  UNION SELECT id, account FROM {_E}
  UNION SELECT id, counterparty FROM {_E} WHERE counterparty IS NOT NULL) t""", "fx_events"))
def q_nested_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 at up to nine levels, with escaped and repeated keys."""
    return parse.touched_accounts(_event_blocks(spark, sf_dir)).select("he_block", "account")


@register("repeated_keys", fx.with_fixtures(f"""
SELECT id AS he_block, symbol, nft_id, account,
       CASE WHEN id % 9 = 4 THEN NULL ELSE CAST(price AS DOUBLE) END AS price
FROM {_E}""", "fx_events"))
def q_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated keys in event data the last counts; such blocks are usable like any other."""
    events = parse.nft_events(parse.parse_blocks(_event_blocks(spark, sf_dir)))
    return comparable(events.select("he_block", "symbol", "nft_id", "account", "price"))


@register("price_quarantine", fx.with_fixtures(f"""
SELECT id AS he_block, symbol, nft_id, '1e23' AS price_raw FROM {_E} WHERE id % 9 = 4""", "fx_events"))
def q_price_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity rows whose price overflows, with the raw text."""
    rows = parse.price_quarantine(parse.parse_blocks(_event_blocks(spark, sf_dir)))
    return rows.select("he_block", "symbol", "nft_id", "price_raw")


@register("repeated_group_keys", fx.with_fixtures("""
SELECT symbol, price_symbol, grouping_key, CAST(MIN(price) AS DOUBLE) AS floor_price, COUNT(*) AS open_orders
FROM fx_orders GROUP BY symbol, price_symbol, grouping_key""", "fx_orders"))
def q_repeated_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups written with a repeated and an escaped key fall into the group of their last value."""
    o = fx.fx_orders(spark, sf_dir)
    messy = F.regexp_replace("grouping_key", r'^\{"class":', r'{"class":"old","cl\\u0061ss": ')
    return comparable(market.market_floor(o.withColumn("grouping", messy).drop("grouping_key")))


@register("quoted_paths", fx.with_fixtures("""
SELECT symbol, nft_id, split_part(properties, '"', 8) AS name, split_part(properties, '"', 4) AS image
FROM fx_holdings WHERE symbol IN ('SYM0', 'SYM1')""", "fx_holdings"))
def q_quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule paths over keys with quotes, dollars and brackets, and properties that repeat a nested key."""
    h = fx.fx_holdings(spark, sf_dir).where(F.col("symbol").isin("SYM0", "SYM1"))
    rarity, name = F.get_json_object("properties", "$.rarity"), F.get_json_object("properties", "$.name")
    props = F.concat(F.lit('{"it\'s":{"x":"old","x":'), _text(rarity), F.lit('},"say \\"$[0]\\"":{"a]b":'), _text(name), F.lit("}}"))
    c = spark.createDataFrame([("SYM0", "Zero", None), ("SYM1", "One", None)], "symbol string, name string, org_name string")
    rule = '{"name":{"from":"properties.it\'s.x"},"image":{"from":"properties.say \\"$[0]\\".a]b"}}'
    rules = spark.createDataFrame([("SYM0", 1, rule), ("SYM1", 1, rule)], "symbol string, version int, mapping string")
    shown = display.display_object(h.withColumn("properties", props), display.compile_rules(rules), c)
    text = lambda k: F.try_variant_get(F.col(f"display.{k}"), "$", "string")
    return shown.select("symbol", "nft_id", text("name").alias("name"), text("image").alias("image"))
