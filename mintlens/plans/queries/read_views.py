"""Read-view queries: wallet (D1-D3, E9), item detail (D4), collection pages and detail (F2, D9), first book
pages (F3), activity feeds (F4), coverage and status (E6-E8), wallet documents (A8 over E9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import display, views
from ...sources import fixtures as fx
from .common import SALES_AS_OF, comparable, nullable_counts_as_double, register, with_ctes
from .open_work import PENDING_SQL, pending_frame
from .display_rules import LATEST_RULES_SQL, rendered_sql


# -- read views ------------------------------------------------------------------

def _wallet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.wallet_view(fx.fx_holdings(spark, sf_dir), fx.fx_orders(spark, sf_dir),
                             fx.fx_collections(spark, sf_dir), fx.fx_mappings(spark, sf_dir))


SECTIONS_SQL = f"""{LATEST_RULES_SQL},
sec AS (
  SELECT account AS viewer, 'owned' AS section, symbol, nft_id, account, owned_by, delegated_to, properties,
         CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS price_symbol FROM fx_holdings
  UNION ALL
  SELECT delegated_to, 'delegated_in', symbol, nft_id, account, owned_by, delegated_to, properties, NULL, NULL
  FROM fx_holdings WHERE delegated_to IS NOT NULL
  UNION ALL
  SELECT o.account, 'listed', o.symbol, o.nft_id, o.account, h.owned_by, h.delegated_to, h.properties,
         CAST(o.price AS DOUBLE), o.price_symbol
  FROM fx_orders o JOIN fx_holdings h ON o.symbol = h.symbol AND o.nft_id = h.nft_id),
d AS (SELECT sec.*, c.name AS collection_name, lm.mapping FROM sec
      LEFT JOIN fx_collections c ON sec.symbol = c.symbol LEFT JOIN lm ON sec.symbol = lm.symbol)"""


@register("wallet_view", with_ctes(SECTIONS_SQL, "fx_mappings", "fx_holdings", "fx_orders", "fx_collections", body=f"""
SELECT viewer, section, symbol, nft_id, account, owned_by, delegated_to, collection_name, price, price_symbol,
       mapping IS NOT NULL AS has_display, {rendered_sql('name')} AS display_name FROM d"""))
def q_wallet_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wallet(spark, sf_dir)
    return comparable(w.select("viewer", "section", "symbol", "nft_id", "account", "owned_by", "delegated_to",
                               "collection_name", "price", "price_symbol",
                               F.col("display").isNotNull().alias("has_display"),
                               display.variant_text(F.col("display.name")).alias("display_name")))


@register("wallet_pages", with_ctes(SECTIONS_SQL, "fx_mappings", "fx_holdings", "fx_orders", "fx_collections", body="""
SELECT viewer, section, symbol, CAST(FLOOR(nft_id / 1000) AS BIGINT) AS id_range, COUNT(*) AS n_items,
       MIN(nft_id) AS first_nft_id, MAX(nft_id) AS last_nft_id
FROM d GROUP BY viewer, section, symbol, CAST(FLOOR(nft_id / 1000) AS BIGINT)"""))
def q_wallet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.wallet_pages(_wallet(spark, sf_dir))
    return p.select("viewer", "section", "symbol", "id_range", F.size("items").cast("bigint").alias("n_items"),
                    F.element_at("items", 1)["nft_id"].alias("first_nft_id"),
                    F.element_at("items", -1)["nft_id"].alias("last_nft_id"))


@register("nft_detail", fx.with_fixtures("""
SELECT h.symbol, h.nft_id, h.account, c.name AS collection_name, o.nft_id IS NOT NULL AS has_open_order,
       CAST(o.price AS DOUBLE) AS order_price, o.price_symbol AS order_price_symbol, o.account AS order_account,
       o.ts AS order_ts
FROM fx_holdings h LEFT JOIN fx_collections c ON h.symbol = c.symbol
LEFT JOIN fx_orders o ON h.symbol = o.symbol AND h.nft_id = o.nft_id""", "fx_holdings", "fx_collections", "fx_orders"))
def q_nft_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.nft_detail(fx.fx_holdings(spark, sf_dir), fx.fx_collections(spark, sf_dir), fx.fx_orders(spark, sf_dir))
    return d.select("symbol", "nft_id", "account", "collection_name",
                    F.col("open_order").isNotNull().alias("has_open_order"),
                    F.col("open_order.price").cast("double").alias("order_price"),
                    F.col("open_order.price_symbol").alias("order_price_symbol"),
                    F.col("open_order.account").alias("order_account"), F.col("open_order.ts").alias("order_ts"))


_COLL_COLS = "symbol, name, supply, circulating_supply, burned, has_display_mapping"
_COLL_SQL_COLS = ("symbol, name, CAST(supply AS DOUBLE) AS supply, CAST(circulating_supply AS DOUBLE) AS circulating_supply, "
                  "CAST(burned AS DOUBLE) AS burned, has_display_mapping")
_COUNTS = ("supply", "circulating_supply", "burned")
_COLL_ROWS_SQL = """cr AS (
  SELECT c.*, supply - circulating_supply AS burned,
         EXISTS (SELECT 1 FROM fx_mappings m WHERE m.symbol = c.symbol) AS has_display_mapping
  FROM fx_collections c)"""
COLLECTIONS_PAGE = 10


@register("collections_page", with_ctes(_COLL_ROWS_SQL, "fx_collections", "fx_mappings", body=f"""
SELECT {_COLL_SQL_COLS} FROM cr WHERE symbol > '' ORDER BY symbol LIMIT {COLLECTIONS_PAGE}"""))
def q_collections_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.collections_page(fx.fx_collections(spark, sf_dir), fx.fx_mappings(spark, sf_dir), "", COLLECTIONS_PAGE)
    return nullable_counts_as_double(p.select(*[c.strip() for c in _COLL_COLS.split(",")]), *_COUNTS)


@register("collection_detail", with_ctes(_COLL_ROWS_SQL, "fx_collections", "fx_mappings", "fx_sales", body=f"""
SELECT {_COLL_SQL_COLS} FROM cr WHERE symbol IN (SELECT symbol FROM fx_sales WHERE price_symbol = 'TOKR')"""))
def q_collection_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = fx.fx_sales(spark, sf_dir).where(F.col("price_symbol") == "TOKR").select("symbol")
    d = views.collection_detail(fx.fx_collections(spark, sf_dir), fx.fx_mappings(spark, sf_dir), req)
    return nullable_counts_as_double(d.select(*[c.strip() for c in _COLL_COLS.split(",")]), *_COUNTS)


BOOK_PAGE = 100


_BOOK_SQL = """
SELECT symbol, nft_id, account, CAST(price AS DOUBLE) AS price, price_symbol,
       CAST(CASE WHEN rn % {n} = 0 THEN nft_id END AS DOUBLE) AS next_cursor FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY nft_id) AS rn FROM fx_orders) t
WHERE rn > {lo} AND rn <= {lo} + {n}"""


def _book_rows(p: DataFrame) -> DataFrame:
    return nullable_counts_as_double(
        comparable(p.select("symbol", "nft_id", "account", "price", "price_symbol", "next_cursor")), "next_cursor")


@register("orders_page", fx.with_fixtures(_BOOK_SQL.format(n=BOOK_PAGE, lo=0), "fx_orders"))
def q_orders_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first page of every symbol's book."""
    return _book_rows(views.orders_pages(fx.fx_orders(spark, sf_dir), BOOK_PAGE))


SHORT_PAGE = 10


@register("orders_page_next", fx.with_fixtures(_BOOK_SQL.format(n=SHORT_PAGE, lo=SHORT_PAGE), "fx_orders"))
def q_orders_second_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the second page of every symbol's book, after the cursors of the first."""
    orders = fx.fx_orders(spark, sf_dir)
    first = views.orders_pages(orders, SHORT_PAGE).where("next_cursor is not null")
    return _book_rows(views.orders_pages(orders, SHORT_PAGE, cursors=first.select("symbol", F.col("next_cursor").alias("cursor"))))


@register("orders_page_seller", fx.with_fixtures(f"""
SELECT symbol, nft_id, account, CAST(price AS DOUBLE) AS price, price_symbol FROM fx_orders
WHERE symbol = 'SYM3' AND account = (SELECT min(account) FROM fx_orders WHERE symbol = 'SYM3') AND nft_id > 50
ORDER BY nft_id LIMIT {SHORT_PAGE}""", "fx_orders"))
def q_orders_page_of_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 for one symbol and seller, after a cursor."""
    from ...operators import market
    orders = fx.fx_orders(spark, sf_dir)
    seller = orders.where("symbol = 'SYM3'").agg(F.min("account")).first()[0]
    return comparable(market.orders_page(orders, "SYM3", cursor=50, limit=SHORT_PAGE, seller=seller).select(
        "symbol", "nft_id", "account", "price", "price_symbol"))


FEED_PAGE = 20
_FEED_SQL = """
SELECT viewer, rank - {lo} AS rank, he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, ts,
       CASE WHEN rank = {lo} + {n} THEN CAST(he_block AS VARCHAR) || ':' || CAST(tx_seq AS VARCHAR) END AS next_cursor FROM (
  SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY he_block DESC, tx_seq DESC) AS rank FROM (
    SELECT account AS viewer, * FROM fx_events WHERE {where}
    UNION SELECT counterparty AS viewer, * FROM fx_events WHERE counterparty IS NOT NULL AND {where}) u) t
WHERE rank > {lo} AND rank <= {lo} + {n}"""


def _feed_rows(feeds: DataFrame) -> DataFrame:
    return comparable(feeds.withColumn("rank", F.col("rank").cast("bigint")))


@register("account_activity", fx.with_fixtures(_FEED_SQL.format(n=FEED_PAGE, lo=0, where="true"), "fx_events"))
def q_activity_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the newest page of every account's feed."""
    return _feed_rows(views.activity_feeds(fx.fx_events(spark, sf_dir), FEED_PAGE))


@register("account_activity_next", fx.with_fixtures(_FEED_SQL.format(n=3, lo=3, where="true"), "fx_events"))
def q_activity_second_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the second page of every account's feed, below the pair cursors of the first."""
    ev = fx.fx_events(spark, sf_dir)
    first = views.activity_feeds(ev, 3).where("next_cursor is not null").select("viewer", F.col("next_cursor").alias("cursor"))
    return _feed_rows(views.activity_feeds(ev, 3, cursors=first))


@register("account_activity_filtered", fx.with_fixtures(_FEED_SQL.format(
    n=FEED_PAGE, lo=0, where="symbol = 'SYM3' AND op = 'transfer'"), "fx_events"))
def q_activity_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every account's feed of one symbol and operation."""
    return _feed_rows(views.activity_feeds(fx.fx_events(spark, sf_dir), FEED_PAGE, symbol="SYM3", op="transfer"))


@register("account_activity_one", fx.with_fixtures(f"""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price, price_symbol, tx_id, ts
FROM fx_events, (SELECT min(account) AS a, max(he_block) AS b FROM fx_events) m
WHERE (account = a OR counterparty = a) AND (he_block < b - 5 OR (he_block = b - 5 AND tx_seq < 4))
ORDER BY he_block DESC, tx_seq DESC LIMIT {FEED_PAGE}""", "fx_events"))
def q_activity_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 for one account, below a cursor."""
    ev = fx.fx_events(spark, sf_dir)
    who, head = ev.agg(F.min("account"), F.max("he_block")).first()
    return comparable(views.account_activity(ev, who, cursor=f"{head - 5}:4", limit=FEED_PAGE).select(*views.ACTIVITY_COLS))


@register("activity_coverage", fx.with_fixtures("""
SELECT 30 AS window_days, MIN(ts) AS oldest_event_ts, CAST(NULL AS DOUBLE) AS backfill_cursor_block,
       greatest(1, MAX(he_block) - 30 * 28800) AS backfill_target_block, false AS backfill_complete
FROM fx_events""", "fx_events"))
def q_activity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 without a backfill."""
    return nullable_counts_as_double(views.activity_coverage(fx.fx_events(spark, sf_dir)), "backfill_cursor_block")


@register("distinct_held_symbols", fx.with_fixtures("SELECT DISTINCT symbol FROM fx_holdings", "fx_holdings"))
def q_distinct_held_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.distinct_held_symbols(fx.fx_holdings(spark, sf_dir))


@register("pipeline_status", with_ctes(PENDING_SQL, "fx_events", "fx_accounts", "fx_scope_outcomes", "fx_holdings",
                                   "fx_mappings", body="""
SELECT 'tracked_accounts' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM fx_accounts
UNION ALL SELECT 'populated_accounts', CAST(COUNT(populated_at) AS DOUBLE) FROM fx_accounts
UNION ALL SELECT 'refresh_queue_depth', CAST(COUNT(*) AS DOUBLE) FROM pending
UNION ALL SELECT 'retry_pending', CAST(COUNT(*) AS DOUBLE) FROM pending WHERE attempts > 0
UNION ALL SELECT 'retry_max_attempts', CAST(MAX(attempts) AS DOUBLE) FROM pending WHERE attempts > 0
UNION ALL SELECT 'retry_next_at_epoch', epoch(MIN(not_before)) FROM pending WHERE attempts > 0
UNION ALL SELECT 'mapped_symbols', CAST(COUNT(*) AS DOUBLE) FROM (SELECT DISTINCT symbol FROM fx_holdings) s
          WHERE symbol IN (SELECT symbol FROM fx_mappings)
UNION ALL SELECT 'held_symbols', CAST(COUNT(DISTINCT symbol) AS DOUBLE) FROM fx_holdings
UNION ALL SELECT 'oldest_event_epoch', epoch(MIN(ts)) FROM fx_events
UNION ALL SELECT 'last_block', CAST(MAX(he_block) AS DOUBLE) FROM fx_events"""))
def q_pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = fx.fx_accounts(spark, sf_dir)
    pend = pending_frame(spark, sf_dir)
    cov = display.mapping_coverage(fx.fx_holdings(spark, sf_dir), fx.fx_mappings(spark, sf_dir))
    ev = fx.fx_events(spark, sf_dir)
    epoch = lambda c: (F.unix_micros(c) / 1e6)
    retrying = F.col("attempts") > 0
    return views.pipeline_status([
        acc.agg(F.count(F.lit(1)).alias("tracked_accounts"), F.count("populated_at").alias("populated_accounts")),
        pend.agg(F.count(F.lit(1)).alias("refresh_queue_depth"), F.count_if(retrying).alias("retry_pending"),
                 F.max(F.when(retrying, F.col("attempts"))).alias("retry_max_attempts"),
                 epoch(F.min(F.when(retrying, F.col("not_before")))).alias("retry_next_at_epoch")),
        cov.select(F.col("mapped").alias("mapped_symbols"), F.col("total").alias("held_symbols")),
        ev.agg(epoch(F.min("ts")).alias("oldest_event_epoch"), F.max("he_block").alias("last_block")),
    ])



@register("wallet_json", with_ctes(SECTIONS_SQL, "fx_mappings", "fx_holdings", "fx_orders", "fx_collections", body="""
SELECT viewer, section, symbol, CAST(FLOOR(nft_id / 1000) AS BIGINT) AS id_range, COUNT(*) AS n_items,
       regexp_replace(regexp_replace(CAST(CAST(arg_min(price, nft_id) AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '')
         AS first_price_text,
       CAST(MIN(nft_id) AS VARCHAR) AS first_nft_id
FROM d GROUP BY viewer, section, symbol, CAST(FLOOR(nft_id / 1000) AS BIGINT)"""))
def q_wallet_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over E9: each nested wallet page as one response document (prices as
    trimmed text at any depth); checked on fields extracted from the JSON."""
    from ...sources.sinks import to_json_view
    pages_ = views.wallet_pages(_wallet(spark, sf_dir))
    j = to_json_view(pages_)
    # one parse of a document gives all fields
    doc = j.select(F.from_json("json", "viewer string, section string, symbol string, id_range string, "
                                       "items array<struct<price:string,nft_id:string>>").alias("d"))
    first = F.element_at("d.items", 1)
    return doc.select("d.viewer", "d.section", "d.symbol", F.col("d.id_range").cast("bigint").alias("id_range"),
                      F.size("d.items").cast("bigint").alias("n_items"),
                      first["price"].alias("first_price_text"), first["nft_id"].alias("first_nft_id"))


@register("wallet_requested", with_ctes(SECTIONS_SQL, "fx_mappings", "fx_holdings", "fx_orders", "fx_collections",
                                        "fx_sales", body=f"""
SELECT viewer, section, symbol, nft_id, account, owned_by, delegated_to, collection_name, price, price_symbol
FROM d WHERE viewer IN (SELECT buyer FROM fx_sales
                        WHERE ts > TIMESTAMP '{SALES_AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{SALES_AS_OF}')"""))
def q_wallet_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3 for a requested set of accounts (the buyers of the last 30 days):
    the viewer frame is semi-joined, so only their rows are built."""
    t = F.lit(SALES_AS_OF).cast("timestamp")
    s = fx.fx_sales(spark, sf_dir)
    buyers = s.where((F.col("ts") > t - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= t)).select(
        F.col("buyer").alias("account"))
    items = views.wallet_sections(fx.fx_holdings(spark, sf_dir), fx.fx_orders(spark, sf_dir),
                                  fx.fx_collections(spark, sf_dir), viewers=buyers)
    return comparable(items.select("viewer", "section", "symbol", "nft_id", "account", "owned_by", "delegated_to",
                                   "collection_name", "price", "price_symbol"))
