"""Snapshot queries: catalog sweep (B2, C1), holdings (C2, C3), order books (B4, C4), market flag (C5),
known symbols (B16), retention (B17), settle margin (B18), account state (C6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import market, parse, state
from ...sources import fixtures as fx
from .common import ORACLE, comparable, fresh_dir, nullable_counts_as_double, register, with_ctes
from .parsing import ev_sql, fx_blocks


# -- snapshots: catalog upsert (B2 + C1) --------------------------------------

def catalog_snapshot_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed catalog records from repeated catalog sweeps: one record per part
    for symbol SYM(5 + partkey % 40), so most symbols arrive many times and the
    latest record (highest ``pos``) wins; SYM0..4 are not in the sweep and
    SYM25..44 are new. metadata arrives as an object (even keys) or as a JSON
    string (odd keys); maxSupply 0 means none."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    pk = F.col("p_partkey")
    key = pk % 40 + 5
    meta_obj = F.to_json(F.struct(F.concat(F.lit("https://x/"), pk.cast("string")).alias("url")))
    meta = F.when(pk % 2 == 0, meta_obj).otherwise(F.to_json(F.array(meta_obj)).substr(F.lit(2), F.length(
        F.to_json(F.array(meta_obj))) - 2))
    rest = F.to_json(F.struct(
        F.concat(F.lit("SYM"), key.cast("string")).alias("symbol"), F.col("p_name").alias("name"),
        F.lit("snap").alias("orgName"), (1000 + key * 10).alias("supply"),
        (1000 + key * 10 - F.col("p_size")).alias("circulatingSupply"),
        F.when(pk % 3 == 0, F.lit(0)).otherwise(pk * 10).alias("maxSupply"), pk.alias("pos")))
    rec = F.concat(F.lit('{"metadata":'), meta, F.lit(","), F.substring(rest, 2, 1 << 30))
    from ...schemas import CATALOG_RAW_DDL
    return p.select(F.from_json(rec, CATALOG_RAW_DDL).alias("r")).select("r.*")


CATALOG_SNAP_SQL = """snap_all AS (
  SELECT 'SYM' || CAST(p_partkey % 40 + 5 AS VARCHAR) AS symbol, p_name AS name, 'snap' AS org_name,
         CAST(1000 + (p_partkey % 40 + 5) * 10 AS BIGINT) AS supply,
         CAST(1000 + (p_partkey % 40 + 5) * 10 - p_size AS BIGINT) AS circulating_supply,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey * 10 AS BIGINT) END AS max_supply,
         'https://x/' || CAST(p_partkey AS VARCHAR) AS url, p_partkey AS pos
  FROM part),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS rn FROM snap_all) t
         WHERE rn = 1)"""


_SUPPLY = ("CAST(supply AS DOUBLE) AS supply, CAST(circulating_supply AS DOUBLE) AS circulating_supply, "
           "CAST(max_supply AS DOUBLE) AS max_supply")


@register("normalize_catalog", with_ctes(CATALOG_SNAP_SQL, "fx_collections",
                                     body=f"SELECT symbol, name, org_name, {_SUPPLY}, url FROM snap_all"))
def q_normalize_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...sources.snapshots import normalize_catalog
    return nullable_counts_as_double(normalize_catalog(catalog_snapshot_raw(spark, sf_dir)).select(
        "symbol", "name", "org_name", "supply", "circulating_supply", "max_supply", "url"),
        "supply", "circulating_supply", "max_supply")


@register("upsert_catalog", with_ctes(CATALOG_SNAP_SQL, "fx_collections", body=f"""
SELECT symbol, name, org_name, {_SUPPLY} FROM (
  SELECT symbol, name, org_name, supply, circulating_supply, max_supply FROM fx_collections
  WHERE symbol NOT IN (SELECT symbol FROM snap)
  UNION ALL SELECT symbol, name, org_name, supply, circulating_supply, max_supply FROM snap) t"""))
def q_upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...sources.snapshots import normalize_catalog
    return nullable_counts_as_double(upserted_catalog(spark, sf_dir), "supply", "circulating_supply", "max_supply")


def upserted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...sources.snapshots import normalize_catalog
    snap = normalize_catalog(catalog_snapshot_raw(spark, sf_dir), keep=("pos",)).select(
        "symbol", "name", "org_name", "supply", "circulating_supply", "max_supply", "pos")
    return state.upsert_catalog(fx.fx_collections(spark, sf_dir), snap)


# -- snapshots: holdings (B3 + C2 + C3) -----------------------------------------
# Re-fetch of every account whose customer key ends in 1: items whose key is
# divisible by 3 were sold away, the others come back with rarity 'R', and the
# account also receives every 4th item of the account one key above it
# (ownership transfer, C3). The scope fails when (custkey + nation) % 3 = 0.
HOLD_FETCH_TS = "2001-09-01 00:00:00"


def _holding_fixture(spark: SparkSession, sf_dir: str):
    h = (fx.fx_holdings(spark, sf_dir).where(F.col("account") != "market")
         .withColumn("ck", F.substring("account", 5, 32).cast("bigint"))
         .withColumn("nk", F.substring("symbol", 4, 8).cast("bigint")))
    own = h.where(F.col("ck") % 10 == 1)
    moved = (h.where((F.col("ck") % 10 == 2) & (F.col("nft_id") % 4 == 0))
             .withColumn("ck", F.col("ck") - 1)
             .withColumn("account", F.concat(F.lit("acct"), F.col("ck").cast("string")))
             .withColumn("owned_by", F.lit("u")).withColumn("delegated_to", F.lit(None).cast("string")))
    fetch_ts = F.lit(HOLD_FETCH_TS).cast("timestamp")
    props = F.regexp_replace("properties", r'"rarity":"[^"]*"', '"rarity":"R"')
    fetched = (own.where(F.col("nft_id") % 3 != 0).withColumn("properties", props).unionByName(moved)
               .withColumn("refreshed_at", fetch_ts))
    scopes = own.select("account", "symbol", "ck", "nk").unionByName(moved.select("account", "symbol", "ck", "nk")).distinct()
    outcomes = scopes.select("account", "symbol", ((F.col("ck") + F.col("nk")) % 3 != 0).alias("ok"),
                             fetch_ts.alias("fetched_at"))
    cols = ["symbol", "nft_id", "account", "owned_by", "delegated_to", "properties", "refreshed_at"]
    return fetched.select(*cols), outcomes


_HOLD_SQL = f"""h AS (SELECT *, CAST(substr(account, 5) AS BIGINT) AS ck, CAST(substr(symbol, 4) AS BIGINT) AS nk
       FROM fx_holdings WHERE account <> 'market'),
own AS (SELECT * FROM h WHERE ck % 10 = 1),
moved AS (SELECT symbol, nft_id, 'acct' || CAST(ck - 1 AS VARCHAR) AS account, 'u' AS owned_by,
                 CAST(NULL AS VARCHAR) AS delegated_to, properties, refreshed_at, ck - 1 AS ck, nk
          FROM h WHERE ck % 10 = 2 AND nft_id % 4 = 0),
fetched AS (
  SELECT symbol, nft_id, account, owned_by, delegated_to,
         regexp_replace(properties, '"rarity":"[^"]*"', '"rarity":"R"') AS properties,
         TIMESTAMP '{HOLD_FETCH_TS}' AS refreshed_at FROM own WHERE nft_id % 3 <> 0
  UNION ALL SELECT symbol, nft_id, account, owned_by, delegated_to, properties, TIMESTAMP '{HOLD_FETCH_TS}' FROM moved),
okscopes AS (SELECT DISTINCT account, symbol FROM (SELECT account, symbol, ck, nk FROM own
             UNION ALL SELECT account, symbol, ck, nk FROM moved) s WHERE (ck + nk) % 3 <> 0),
allrows AS (
  SELECT x.*, 0 AS src FROM fx_holdings x
  WHERE NOT EXISTS (SELECT 1 FROM okscopes s WHERE s.account = x.account AND s.symbol = x.symbol
                    AND x.refreshed_at <= TIMESTAMP '{HOLD_FETCH_TS}')
  UNION ALL
  SELECT f.*, 1 FROM fetched f WHERE EXISTS (SELECT 1 FROM okscopes s WHERE s.account = f.account AND s.symbol = f.symbol))"""


@register("apply_holdings", with_ctes(_HOLD_SQL, "fx_holdings", body="""
SELECT symbol, nft_id, account, owned_by, delegated_to, properties, refreshed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, nft_id ORDER BY refreshed_at DESC, src DESC) AS rn FROM allrows) t
WHERE rn = 1"""))
def q_apply_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, outcomes = _holding_fixture(spark, sf_dir)
    return state.apply_holdings(fx.fx_holdings(spark, sf_dir), fetched, outcomes)


# -- snapshots: order books (B4 + C4) ----------------------------------------
# New books for symbols whose nation key is divisible by 3, built from the
# pending ('P') orders; every 5th order appears twice (the later copy, priced
# one higher, must lose). The fetch succeeds for even nation keys and is
# complete except for SYM12 (cut short -> the old book stays).
BOOK_FETCH_TS = "2001-09-01 00:00:00"


def book_fixture(spark: SparkSession, sf_dir: str):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                 "o_orderdate", "o_orderpriority")
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    d = o.join(c, o.o_custkey == c.c_custkey).where((F.col("o_orderstatus") == "P") & (F.col("c_nationkey") % 3 == 0))
    k = F.col("o_orderkey")
    ms = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")
    rec = lambda bump, pos: F.struct(
        F.concat(F.lit("SYM"), F.col("c_nationkey").cast("string")).alias("symbol"), k.cast("string").alias("nftId"),
        F.concat(F.lit("acct"), F.col("o_custkey").cast("string")).alias("account"),
        (F.col("o_totalprice").cast("decimal(18,2)") + bump).cast("string").alias("price"),
        F.concat(F.lit("TOK"), (k % 3).cast("string")).alias("priceSymbol"), ms.alias("timestamp"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(
            F.concat(F.lit('{"class":"'), F.col("o_orderpriority"), F.lit('"}'))).alias("grouping"),
        pos.alias("pos"))
    from ...schemas import ORDER_RAW_DDL
    from ...sources.snapshots import normalize_orders
    docs = d.select(rec(0, k * 2).alias("r")).unionByName(d.where(k % 5 == 0).select(rec(1, k * 2 + 1).alias("r")))
    raw = docs.select(F.from_json(F.to_json("r"), ORDER_RAW_DDL).alias("o")).select("o.*")
    orders = normalize_orders(raw, keep=("pos",)).select(
        "symbol", "nft_id", "account", "owned_by", "price", "price_symbol",
        F.col("grouping").alias("grouping_key"), "ts", "pos")
    n = fx.table(spark, sf_dir, "nation").select("n_nationkey").where(F.col("n_nationkey") % 3 == 0)
    nk = F.col("n_nationkey")
    outcomes = n.select(F.concat(F.lit("SYM"), nk.cast("string")).alias("symbol"), (nk % 2 == 0).alias("ok"),
                        (nk != 12).alias("complete"), F.lit(BOOK_FETCH_TS).cast("timestamp").alias("fetched_at"))
    return orders, outcomes


@register("apply_book", fx.with_fixtures("""
SELECT symbol, nft_id, account, owned_by, CAST(price AS DOUBLE) AS price, price_symbol, grouping_key, ts FROM fx_orders
WHERE CAST(substr(symbol, 4) AS INTEGER) NOT IN (0, 6, 18, 24)
UNION ALL
SELECT 'SYM' || CAST(c_nationkey AS VARCHAR), o_orderkey, 'acct' || CAST(o_custkey AS VARCHAR), 'u',
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), 'TOK' || CAST(o_orderkey % 3 AS VARCHAR),
       CASE WHEN o_orderkey % 5 = 0 THEN '{}' ELSE '{"class":"' || o_orderpriority || '"}' END,
       CAST(o_orderdate AS TIMESTAMP)
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'P' AND c_nationkey IN (0, 6, 18, 24)""", "fx_orders"))
def q_apply_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, outcomes = book_fixture(spark, sf_dir)
    return comparable(state.apply_book(fx.fx_orders(spark, sf_dir), orders, outcomes))


@register("derive_market_enabled", fx.with_fixtures("""
SELECT c.symbol, c.name, EXISTS (SELECT 1 FROM fx_orders o WHERE o.symbol = c.symbol) AS market_enabled
FROM fx_collections c""", "fx_collections", "fx_orders"))
def q_derive_market_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.fx_collections(spark, sf_dir).select("symbol", "name")
    return market.derive_market_enabled(c, fx.fx_orders(spark, sf_dir))


@register("known_symbols", fx.with_fixtures("""
SELECT symbol FROM fx_collections c
WHERE circulating_supply IS NULL OR circulating_supply > 0
   OR EXISTS (SELECT 1 FROM fx_holdings h WHERE h.symbol = c.symbol)""", "fx_collections", "fx_holdings"))
def q_known_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.known_symbols(fx.fx_collections(spark, sf_dir), fx.fx_holdings(spark, sf_dir))


RETAIN_AS_OF = "2024-02-15 00:00:00"


@register("retain", fx.with_fixtures(f"""
SELECT he_block, tx_seq, ts FROM fx_events WHERE ts >= TIMESTAMP '{RETAIN_AS_OF}' - INTERVAL 30 DAY""", "fx_events"))
def q_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.retain(fx.fx_events(spark, sf_dir), RETAIN_AS_OF).select("he_block", "tx_seq", "ts")


@register("settled_blocks", ev_sql("SELECT DISTINCT he_block FROM ev WHERE he_block <= (SELECT max(he_block) FROM ev) - 1"))
def q_settled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B18 below the highest block that has landed."""
    blocks = parse.typed_blocks(fx_blocks(spark, sf_dir)).select("he_block")
    return state.settled_blocks(blocks, blocks.agg(F.max("he_block")).first()[0])


ACCOUNTS_AS_OF = "2001-08-01 03:00:00"


@register("account_state", fx.with_fixtures(f"""
SELECT r.account,
       CASE WHEN a.account IS NULL AND r.account <> 'market' THEN 'absent'
            WHEN a.populated_at IS NULL THEN 'tracked' ELSE 'populated' END AS state,
       COALESCE(a.refreshed_at < TIMESTAMP '{ACCOUNTS_AS_OF}' - INTERVAL 6 HOUR, false)
         AND a.populated_at IS NOT NULL AS stale
FROM (SELECT account FROM fx_holdings UNION SELECT delegated_to FROM fx_holdings WHERE delegated_to IS NOT NULL) r
LEFT JOIN fx_accounts a ON a.account = r.account""", "fx_holdings", "fx_accounts"))
def q_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.fx_holdings(spark, sf_dir)
    req = h.select("account").union(h.where(F.col("delegated_to").isNotNull()).select(F.col("delegated_to").alias("account")))
    return state.account_state(fx.fx_accounts(spark, sf_dir), ACCOUNTS_AS_OF, requested=req, escrow="market")


@register("apply_holdings_table", ORACLE["apply_holdings"])
def q_apply_holdings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2/C3 as a table job: holdings stored by symbol and bucket; only the
    buckets that the refresh changes are rewritten."""
    path, _ = _refreshed_table(spark, sf_dir)
    return spark.read.parquet(path).select(*HOLDING_COLS)


HOLDING_COLS = ["symbol", "nft_id", "account", "owned_by", "delegated_to", "properties", "refreshed_at"]


def _refreshed_table(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    from ..jobs import apply_holdings_table, write_holdings
    path = fresh_dir(spark, "holdings-table")
    write_holdings(fx.fx_holdings(spark, sf_dir), path, buckets=4)
    fetched, outcomes = _holding_fixture(spark, sf_dir)
    apply_holdings_table(spark, path, fetched, outcomes, buckets=4)
    return path, outcomes


LATE_TS = "1998-01-01 00:00:00"


@register("late_fetches", with_ctes(_HOLD_SQL, "fx_holdings", body=f"""
SELECT symbol, nft_id, account, owned_by, delegated_to, properties, refreshed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, nft_id ORDER BY refreshed_at DESC, src DESC) AS rn FROM allrows) t
WHERE rn = 1 AND NOT (refreshed_at <= TIMESTAMP '{LATE_TS}' AND (account, symbol) IN (
  SELECT (account, symbol) FROM (SELECT account, symbol, ck, nk FROM own UNION SELECT account, symbol, ck, nk FROM moved) s
  WHERE (ck + nk) % 3 = 0))"""))
def q_late_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 by time: after the refresh, empty complete fetches of years before arrive for the same scopes. Scopes refreshed since
    keep their rows; of the scopes whose refresh failed, only rows as old as the late fetch go."""
    from ..jobs import apply_holdings_table
    path, outcomes = _refreshed_table(spark, sf_dir)
    late = outcomes.select("account", "symbol", F.lit(True).alias("ok"), F.lit(LATE_TS).cast("timestamp").alias("fetched_at"))
    apply_holdings_table(spark, path, fx.fx_holdings(spark, sf_dir).limit(0), late, buckets=4)
    return spark.read.parquet(path).select(*HOLDING_COLS)


@register("apply_book_table", ORACLE["apply_book"])
def q_apply_book_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 as a table job: the book stored partitioned by symbol; only symbols
    with a confirmed snapshot are rewritten."""
    from ..jobs import apply_book_table
    path = fresh_dir(spark, "book-table")
    cur = fx.fx_orders(spark, sf_dir)
    cur.write.partitionBy("symbol").parquet(path)
    orders, outcomes = book_fixture(spark, sf_dir)
    apply_book_table(spark, path, orders, outcomes)
    return comparable(spark.read.parquet(path).select(*cur.columns))


@register("late_books", ORACLE["apply_book"].replace(
    "NOT IN (0, 6, 18, 24)", "% 3 <> 0", 1))
def q_late_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 by time: after the new books, empty complete snapshots of years before arrive for all symbols of the fixture: books
    that are newer stay, those whose new snapshot failed or was cut short are emptied."""
    from ..jobs import apply_book_table
    path = fresh_dir(spark, "late-books")
    cur = fx.fx_orders(spark, sf_dir)
    cur.write.partitionBy("symbol").parquet(path)
    orders, outcomes = book_fixture(spark, sf_dir)
    apply_book_table(spark, path, orders, outcomes)
    late = outcomes.select("symbol", F.lit(True).alias("ok"), F.lit(LATE_TS).cast("timestamp").alias("fetched_at"))
    apply_book_table(spark, path, orders.limit(0), late)
    return comparable(spark.read.parquet(path).select(*cur.columns))
