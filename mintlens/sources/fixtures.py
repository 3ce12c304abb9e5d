"""Domain tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables; these functions turn them into the
domain tables the operators consume (collections, holdings, open orders,
sales, activity events, tracked accounts, fetch outcomes, display rules),
so every operator runs over data that grows with the scale factor. The same
derivations exist as SQL text (``FX_SQL``) for the DuckDB oracle; the two are
kept in step by ``tests/test_fixtures.py``.

Column pruning reaches the parquet scan: each builder selects only what it
uses before any join, and the dimension joins are on tiny tables
(nation/region) or on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import PRICE_TYPE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sym(c) -> F.Column:
    return F.concat(F.lit("SYM"), c.cast("string"))


def _ts(c) -> F.Column:
    # driver timestamps are timestamp_ntz; the domain uses session-zone (UTC) timestamps
    return c.cast("timestamp")


def fx_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    k = F.col("n_nationkey")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(_sym(k).alias("symbol"), F.col("n_name").alias("name"),
                    F.col("r_name").alias("org_name"),
                    (1000 + k * 10).cast("bigint").alias("supply"),
                    F.when(k % 8 == 7, F.lit(None).cast("bigint"))
                     .when(k % 8 == 3, F.lit(0).cast("bigint"))
                     .otherwise((900 + k * 7).cast("bigint")).alias("circulating_supply"),
                    F.nullif((k % 3).cast("bigint") * 1000, F.lit(0).cast("bigint")).alias("max_supply")))


def _orders_with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey)


def fx_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_with_nation(spark, sf_dir)
    is_open = F.col("o_orderstatus") == "O"
    return d.select(
        _sym(F.col("c_nationkey")).alias("symbol"),
        F.col("o_orderkey").alias("nft_id"),
        F.when(is_open, F.lit("market")).otherwise(F.concat(F.lit("acct"), F.col("o_custkey").cast("string"))).alias("account"),
        F.when(is_open, F.lit("c")).otherwise(F.lit("u")).alias("owned_by"),
        F.when(F.col("o_orderkey") % 7 == 0,
               F.concat(F.lit("acct"), (F.col("o_custkey") + 1).cast("string"))).alias("delegated_to"),
        F.concat(F.lit('{"name":"'), F.col("o_orderpriority"), F.lit('","rarity":"'),
                 F.col("o_orderstatus"), F.lit('"}')).alias("properties"),
        _ts(F.col("o_orderdate")).alias("refreshed_at"))


def fx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders_with_nation(spark, sf_dir).where(F.col("o_orderstatus") == "O")
    k = F.col("o_orderkey")
    return d.select(
        _sym(F.col("c_nationkey")).alias("symbol"), k.alias("nft_id"),
        F.concat(F.lit("acct"), F.col("o_custkey").cast("string")).alias("account"),
        F.lit("u").alias("owned_by"),
        F.col("o_totalprice").cast("decimal(18,2)").cast(PRICE_TYPE).alias("price"),
        F.concat(F.lit("TOK"), (k % 3).cast("string")).alias("price_symbol"),
        F.when(k % 5 == 0, F.lit("{}"))
         .otherwise(F.concat(F.lit('{"class":"'), F.col("o_orderpriority"), F.lit('"}'))).alias("grouping_key"),
        _ts(F.col("o_orderdate")).alias("ts"))


def fx_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_extendedprice", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        _sym(F.col("l_partkey") % 25).alias("symbol"), F.col("l_partkey").alias("nft_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(PRICE_TYPE).alias("price"),
        F.concat(F.lit("TOK"), F.col("l_returnflag")).alias("price_symbol"),
        F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")).alias("seller"),
        F.concat(F.lit("acct"), F.col("o_custkey").cast("string")).alias("buyer"),
        F.col("l_orderkey").alias("he_block"), _ts(F.col("l_shipdate")).alias("ts"))


# Driver event type -> activity op label used by the fixture.
EVENT_TYPE_OP = {"view": "transfer", "click": "issue", "purchase": "market_buy", "signup": "market_list"}
EVENT_TYPE_OP_ELSE = "burn"


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    op = F.lit(EVENT_TYPE_OP_ELSE)
    for k, v in reversed(list(EVENT_TYPE_OP.items())):
        op = F.when(et == k, F.lit(v)).otherwise(op)
    priced = et.isin("purchase", "signup")
    uid = F.col("user_id")
    return e.select(
        F.floor(F.col("event_id") / 10).cast("bigint").alias("he_block"),
        (F.col("event_id") % 10).cast("int").alias("tx_seq"),
        _sym(F.col("event_id") % 25).alias("symbol"),
        (F.col("event_id") % 997).alias("nft_id"),
        op.alias("op"),
        F.concat(F.lit("u"), uid.cast("string")).alias("account"),
        F.when(et.isin("view", "purchase"),
               F.concat(F.lit("u"), ((uid * 7 + 3) % 150).cast("string"))).alias("counterparty"),
        F.when(priced, F.col("value").cast("decimal(18,2)")).cast(PRICE_TYPE).alias("price"),
        F.when(priced, F.concat(F.lit("TOK"), (F.col("event_id") % 3).cast("string"))).alias("price_symbol"),
        F.concat(F.lit("tx"), F.col("event_id").cast("string")).alias("tx_id"),
        _ts(F.col("ts")).alias("ts"))


def fx_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return (o.groupBy("o_custkey")
            .agg(F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("refreshed_at"))
            .select(F.concat(F.lit("acct"), F.col("o_custkey").cast("string")).alias("account"),
                    _ts(F.col("first_seen_at")).alias("first_seen_at"),
                    _ts(F.col("refreshed_at")).alias("refreshed_at"),
                    F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("timestamp"))
                     .otherwise(_ts(F.col("refreshed_at"))).alias("populated_at")))


def fx_scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account"),
                    _sym(F.col("event_id") % 25).alias("symbol"),
                    (F.col("event_type") != "error").alias("ok"),
                    _ts(F.col("ts")).alias("fetched_at"))


def fx_book_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book fetches per symbol: a 'click' event is a successful book
    snapshot of its symbol, an 'error' event a failed one."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").where(
        F.col("event_type").isin("click", "error"))
    return e.select(_sym(F.col("event_id") % 25).alias("symbol"), (F.col("event_type") == "click").alias("ok"),
                    _ts(F.col("ts")).alias("fetched_at"))


# The four hand-written rule rows (two versions for SYM0, a
# missing template key for SYM2).
FX_MAPPING_ROWS = [
    ("SYM0", 1, '{"name":{"template":"{symbol} #{nft_id}"}}'),
    ("SYM0", 2, '{"name":{"from":"properties.name"},"attributes":["rarity","missing"]}'),
    ("SYM1", 1, '{"name":{"template":"{symbol} #{nft_id}"},"image":{"template":"https://img/{rarity}/{nft_id}.png"}}'),
    ("SYM2", 1, '{"name":{"template":"{nope}"},"attributes":["name"]}'),
]


def fx_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four fixed rule rows plus one rule version per part whose key falls
    on SYM3..SYM9 (so the rule table grows with the data and most symbols
    have many versions); SYM10.. stay unmapped."""
    fixed = spark.createDataFrame(FX_MAPPING_ROWS, "symbol string, version int, mapping string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    pk = F.col("p_partkey")
    derived = (p.where((pk % 25 >= 3) & (pk % 25 <= 9))
               .select(_sym(pk % 25).alias("symbol"), pk.cast("int").alias("version"),
                       F.concat(F.lit('{"name":{"from":"properties.name"},"image":{"template":"https://img/{symbol}/{nft_id}/'),
                                F.col("p_size").cast("string"),
                                F.lit('.png"},"attributes":["rarity","'), F.col("p_brand"), F.lit('"]}')).alias("mapping")))
    return fixed.unionByName(derived)


FIXTURES = {
    "fx_collections": fx_collections, "fx_holdings": fx_holdings, "fx_orders": fx_orders,
    "fx_sales": fx_sales, "fx_events": fx_events, "fx_accounts": fx_accounts,
    "fx_scope_outcomes": fx_scope_outcomes, "fx_mappings": fx_mappings,
    "fx_book_outcomes": fx_book_outcomes,
}


# -- the same derivations as SQL text (DuckDB oracle CTEs) ---------------------

FX_SQL = {
    "fx_collections": """
SELECT 'SYM' || CAST(n_nationkey AS VARCHAR) AS symbol, n_name AS name, r_name AS org_name,
       CAST(1000 + n_nationkey * 10 AS BIGINT) AS supply,
       CASE WHEN n_nationkey % 8 = 7 THEN NULL WHEN n_nationkey % 8 = 3 THEN CAST(0 AS BIGINT)
            ELSE CAST(900 + n_nationkey * 7 AS BIGINT) END AS circulating_supply,
       NULLIF(CAST(n_nationkey % 3 AS BIGINT) * 1000, 0) AS max_supply
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "fx_holdings": """
SELECT 'SYM' || CAST(c_nationkey AS VARCHAR) AS symbol, o_orderkey AS nft_id,
       CASE WHEN o_orderstatus = 'O' THEN 'market' ELSE 'acct' || CAST(o_custkey AS VARCHAR) END AS account,
       CASE WHEN o_orderstatus = 'O' THEN 'c' ELSE 'u' END AS owned_by,
       CASE WHEN o_orderkey % 7 = 0 THEN 'acct' || CAST(o_custkey + 1 AS VARCHAR) END AS delegated_to,
       '{"name":"' || o_orderpriority || '","rarity":"' || o_orderstatus || '"}' AS properties,
       o_orderdate AS refreshed_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_orders": """
SELECT 'SYM' || CAST(c_nationkey AS VARCHAR) AS symbol, o_orderkey AS nft_id,
       'acct' || CAST(o_custkey AS VARCHAR) AS account, 'u' AS owned_by,
       CAST(o_totalprice AS DECIMAL(18,2)) AS price, 'TOK' || CAST(o_orderkey % 3 AS VARCHAR) AS price_symbol,
       CASE WHEN o_orderkey % 5 = 0 THEN '{}' ELSE '{"class":"' || o_orderpriority || '"}' END AS grouping_key,
       o_orderdate AS ts
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""",
    "fx_sales": """
SELECT 'SYM' || CAST(l_partkey % 25 AS VARCHAR) AS symbol, l_partkey AS nft_id,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price, 'TOK' || l_returnflag AS price_symbol,
       'sup' || CAST(l_suppkey AS VARCHAR) AS seller, 'acct' || CAST(o_custkey AS VARCHAR) AS buyer,
       l_orderkey AS he_block, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_events": """
SELECT CAST(FLOOR(event_id / 10) AS BIGINT) AS he_block, CAST(event_id % 10 AS INT) AS tx_seq,
       'SYM' || CAST(event_id % 25 AS VARCHAR) AS symbol, event_id % 997 AS nft_id,
       CASE event_type WHEN 'view' THEN 'transfer' WHEN 'click' THEN 'issue' WHEN 'purchase' THEN 'market_buy'
                       WHEN 'signup' THEN 'market_list' ELSE 'burn' END AS op,
       'u' || CAST(user_id AS VARCHAR) AS account,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'u' || CAST((user_id * 7 + 3) % 150 AS VARCHAR) END AS counterparty,
       CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS DECIMAL(18,2)) END AS price,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'TOK' || CAST(event_id % 3 AS VARCHAR) END AS price_symbol,
       'tx' || CAST(event_id AS VARCHAR) AS tx_id, ts
FROM events""",
    "fx_accounts": """
SELECT 'acct' || CAST(o_custkey AS VARCHAR) AS account, MIN(o_orderdate) AS first_seen_at, MAX(o_orderdate) AS refreshed_at,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE MAX(o_orderdate) END AS populated_at
FROM orders GROUP BY o_custkey""",
    "fx_scope_outcomes": """
SELECT 'u' || CAST(user_id AS VARCHAR) AS account, 'SYM' || CAST(event_id % 25 AS VARCHAR) AS symbol,
       event_type <> 'error' AS ok, ts AS fetched_at
FROM events""",
    "fx_book_outcomes": """
SELECT 'SYM' || CAST(event_id % 25 AS VARCHAR) AS symbol, event_type = 'click' AS ok, ts AS fetched_at
FROM events WHERE event_type IN ('click', 'error')""",
    "fx_mappings": """
SELECT * FROM (VALUES
  ('SYM0', 1, '{"name":{"template":"{symbol} #{nft_id}"}}'),
  ('SYM0', 2, '{"name":{"from":"properties.name"},"attributes":["rarity","missing"]}'),
  ('SYM1', 1, '{"name":{"template":"{symbol} #{nft_id}"},"image":{"template":"https://img/{rarity}/{nft_id}.png"}}'),
  ('SYM2', 1, '{"name":{"template":"{nope}"},"attributes":["name"]}')
) AS t(symbol, version, mapping)
UNION ALL
SELECT 'SYM' || CAST(p_partkey % 25 AS VARCHAR), CAST(p_partkey AS INTEGER),
       '{"name":{"from":"properties.name"},"image":{"template":"https://img/{symbol}/{nft_id}/' || CAST(p_size AS VARCHAR)
       || '.png"},"attributes":["rarity","' || p_brand || '"]}'
FROM part WHERE p_partkey % 25 BETWEEN 3 AND 9""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture views it uses as CTEs."""
    ctes = ",\n".join(f"{n} AS ({FX_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"


# -- fx_blocks: block documents built from fx_events ---------------------------
# Fixed encoding (one transaction per activity row, in event order):
#   transfer    -> nft/transfer        {from, to, symbol, id:number}
#   issue       -> nft/issue           {account, symbol, id:text}; in even blocks the
#                  tx belongs to "packmanager" and logs its own openPack event first
#   market_list -> nftmarket/sellOrder {account, symbol, nftId:text, price, priceSymbol}
#   market_buy  -> nftmarket buy tx, hitSellOrder {symbol, account, priceSymbol,
#                  sellers:[{account, nftSales:[{id, price, fee, symbol?}]}]}
#   burn        -> nft/burn            {account, symbol, id:number}
# Every block starts with an admin setProperties tx (payload only; in blocks
# divisible by 7 it also logs an unrecognized "updateRoyalty" event), odd blocks
# end with a foreign "tokens" transfer. Logs are an object in even blocks and a
# JSON string in odd ones; the block timestamp is the earliest event time, with
# a trailing Z in blocks divisible by 3 and missing in blocks ending in 49 of 50.
BLOCK_INGEST_TS = "2024-02-01 00:00:00"


def _jstr(c) -> F.Column:
    """A column as a JSON string literal (quoted; backslash and quote escaped
    -- the fixture's values hold no control characters), or null."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def _obj(*pairs) -> F.Column:
    """JSON object text from (key, json_text_column_or_None) pairs; a NULL
    value drops the key (its part is NULL: a value is named once, as nested objects would double their work at each level)."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fx_block_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx_events(spark, sf_dir).withColumn("event_id", F.col("he_block") * 10 + F.col("tx_seq"))
    b, op = F.col("he_block"), F.col("op")
    s = lambda c: _jstr(F.col(c) if isinstance(c, str) else c)
    id_txt = F.col("nft_id").cast("string")
    price_txt = F.col("price").cast("decimal(18,2)").cast("string")
    c = F.col
    data = (F.when(op == "transfer", F.to_json(F.struct(c("account").alias("from"), c("counterparty").alias("to"),
                                                        "symbol", c("nft_id").alias("id"))))
            .when(op == "issue", F.to_json(F.struct("account", "symbol", id_txt.alias("id"))))
            .when(op == "market_list", F.to_json(F.struct("account", "symbol", id_txt.alias("nftId"),
                                                          price_txt.alias("price"),
                                                          c("price_symbol").alias("priceSymbol"))))
            .when(op == "market_buy", F.to_json(F.struct(
                "symbol", "account", c("price_symbol").alias("priceSymbol"),
                F.array(F.struct(c("counterparty").alias("account"), F.array(F.struct(
                    id_txt.alias("id"), price_txt.alias("price"), F.lit(0).alias("fee"),
                    F.when(c("event_id") % 2 == 0, c("price_symbol")).alias("symbol"))).alias("nftSales"))).alias("sellers"))))
            .otherwise(F.to_json(F.struct("account", "symbol", c("nft_id").alias("id")))))
    event_name = (F.when(op == "transfer", "transfer").when(op == "issue", "issue")
                  .when(op == "market_list", "sellOrder").when(op == "market_buy", "hitSellOrder")
                  .otherwise("burn"))
    contract = F.when(op.startswith("market_"), "nftmarket").otherwise("nft")
    packed = (op == "issue") & (b % 2 == 0)
    nft_event = _obj(("contract", _jstr(contract)), ("event", _jstr(event_name)), ("data", data))
    pack_event = _obj(("contract", _jstr(F.lit("packmanager"))), ("event", _jstr(F.lit("openPack"))),
                      ("data", _obj(("account", s("account")), ("symbol", _jstr(F.lit("PACK"))),
                                    ("id", F.col("tx_seq").cast("string")))))
    events = F.concat(F.lit("["), F.when(packed, F.concat(pack_event, F.lit(","))).otherwise(F.lit("")),
                      nft_event, F.lit("]"))
    tx_contract = F.when(packed, "packmanager").otherwise(contract)
    action = (F.when(packed, "open").when(op == "market_buy", "buy").when(op == "market_list", "sell")
              .otherwise(op))
    txs = e.select("he_block", "event_id", "ts", _tx_json(b, tx_contract, action, F.col("account"), F.col("tx_id"),
                                                          F.lit("{}"), _obj(("events", events))).alias("tx"))
    per_block = (txs.groupBy("he_block")
                 .agg(F.min("ts").alias("ts"),
                      F.array_sort(F.collect_list(F.struct("event_id", "tx"))).alias("txs")))
    admin_payload = _obj(("symbol", _jstr(F.concat(F.lit("SYM"), (b % 25).cast("string")))),
                         ("nfts", F.concat(F.lit("["), _obj(("id", _jstr(b.cast("string"))), ("properties", _obj(
                             ("k", (b % 5).cast("string"))))), F.lit("]"))))
    issuer = F.concat(F.lit("issuer"), (b % 13).cast("string"))
    admin_logs = F.when(b % 7 == 0, _obj(("events", F.concat(F.lit("["), _obj(
        ("contract", _jstr(F.lit("nft"))), ("event", _jstr(F.lit("updateRoyalty"))),
        ("data", _obj(("symbol", _jstr(F.concat(F.lit("SYM"), (b % 25).cast("string")))), ("issuer", _jstr(issuer))))),
        F.lit("]"))))).otherwise(F.lit("{}"))
    admin = _tx_json(b, F.lit("nft"), F.lit("setProperties"), issuer,
                     F.concat(F.lit("adm"), b.cast("string")), admin_payload, admin_logs)
    foreign = _tx_json(b, F.lit("tokens"), F.lit("transfer"), F.concat(F.lit("w"), b.cast("string")),
                       F.concat(F.lit("tok"), b.cast("string")), F.lit("{}"),
                       _obj(("events", F.concat(F.lit("["), _obj(
                           ("contract", _jstr(F.lit("tokens"))), ("event", _jstr(F.lit("transfer"))),
                           ("data", _obj(("from", _jstr(F.concat(F.lit("w"), b.cast("string")))),
                                         ("to", _jstr(F.lit("bank"))), ("symbol", _jstr(F.lit("BEE")))))),
                           F.lit("]")))))
    all_txs = F.concat(F.array(admin), F.transform("txs", lambda x: x["tx"]),
                       F.when(b % 2 == 1, F.array(foreign)).otherwise(F.array().cast("array<string>")))
    ts_txt = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ts_txt = F.when(b % 50 == 49, F.lit(None)).when(b % 3 == 0, F.concat(ts_txt, F.lit("Z"))).otherwise(ts_txt)
    doc = _obj(("blockNumber", b.cast("string")), ("timestamp", _jstr(ts_txt)),
               ("transactions", F.concat(F.lit("["), F.array_join(all_txs, ","), F.lit("]"))),
               ("ingestTs", _jstr(F.lit(BLOCK_INGEST_TS))))
    return per_block.select("he_block", doc.alias("value"))


def _tx_json(b, contract, action, sender, tx_id, payload_obj, logs_obj) -> F.Column:
    """One transaction; logs is an object in even blocks, a JSON string in odd ones."""
    logs = F.when(b % 2 == 0, logs_obj).otherwise(_jstr(logs_obj))
    return _obj(("contract", _jstr(contract)), ("action", _jstr(action)), ("sender", _jstr(sender)),
                ("transactionId", _jstr(tx_id)), ("payload", payload_obj), ("logs", logs))
