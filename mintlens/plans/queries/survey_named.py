"""Queries keyed by the remaining function names of the blueprint: wallet sections (D1-D3), group key
(E2), parse composite (B14), sequence (B11), burned (B19), order normalizer (B4), batch block reader (A1),
dual-encoded logs (B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import parse
from ...sources import fixtures as fx
from .common import ORACLE, QUERIES, comparable, fresh_dir, nullable_counts_as_double, register, with_ctes
from .parsing import ev_sql, fx_blocks, fx_parsed
from .snapshots import _HOLD_SQL, _holding_fixture, CATALOG_SNAP_SQL, upserted_catalog
from .display_rules import rendered_sql
from .read_views import SECTIONS_SQL


# -- survey-named operators without a query of their own -------------------------

def _section_query(section: str):
    @register(f"wallet_{section}", with_ctes(SECTIONS_SQL, "fx_mappings", "fx_holdings", "fx_orders", "fx_collections",
                                         body=f"""
SELECT viewer, section, symbol, nft_id, account, owned_by, delegated_to, collection_name, price, price_symbol,
       mapping IS NOT NULL AS has_display, {rendered_sql('name')} AS display_name FROM d WHERE section = '{section}'"""))
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES["wallet_view"](spark, sf_dir).where(F.col("section") == section)
    q.__name__ = f"q_wallet_{section}"
    return q


# One section each (the union branch of the other sections is pruned)
for _sec in ("owned", "delegated_in", "listed"):
    _section_query(_sec)


@register("grouping_key", fx.with_fixtures("""
SELECT symbol, nft_id,
       CASE WHEN nft_id % 5 = 0 THEN '{}'
            ELSE '{"class":"' || o_orderpriority || '","tier":"T' || CAST(nft_id % 4 AS VARCHAR) || '"}' END AS grouping_key
FROM fx_orders JOIN orders ON nft_id = o_orderkey""", "fx_orders"))
def q_grouping_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same group written with its keys in either order (and {} or
    absent) gets one canonical text key."""
    from ...functions import grouping_key
    o = fx.fx_orders(spark, sf_dir).select("symbol", "nft_id")
    prio = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nft_id"), "o_orderpriority")
    k = F.col("nft_id")
    tier = F.concat(F.lit("T"), (k % 4).cast("string"))
    g = (F.when(k % 5 == 0, F.when(k % 2 == 0, F.lit("{}")))
         .when(k % 2 == 0, F.concat(F.lit('{"class":"'), F.col("o_orderpriority"), F.lit('","tier":"'), tier, F.lit('"}')))
         .otherwise(F.concat(F.lit('{ "tier" : "'), tier, F.lit('", "class": "'), F.col("o_orderpriority"), F.lit('" }'))))
    return o.join(prio, "nft_id").select("symbol", "nft_id", grouping_key(g).alias("grouping_key"))


@register("parse_block", ev_sql("""
SELECT e.he_block, e.n_events, e.n_sales, s.n_scopes FROM
  (SELECT he_block, COUNT(*) AS n_events, COUNT(*) FILTER (WHERE op = 'market_buy') AS n_sales FROM ev GROUP BY he_block) e
  JOIN (SELECT he_block, COUNT(*) AS n_scopes FROM (
          SELECT DISTINCT he_block, account, symbol FROM (
            SELECT he_block, account, symbol FROM ev
            UNION ALL SELECT he_block, counterparty, symbol FROM ev WHERE counterparty IS NOT NULL
            UNION ALL SELECT he_block, 'issuer' || CAST(he_block % 13 AS VARCHAR), '' FROM ev) u) d
        GROUP BY he_block) s ON e.he_block = s.he_block"""))
def q_parse_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-pass composite -- per block, how many activity rows, sales
    and distinct touched scopes the single parse produced."""
    p = fx_parsed(spark, sf_dir)
    return p.select("he_block", F.size("events").cast("bigint").alias("n_events"),
                    F.size("sales").cast("bigint").alias("n_sales"), F.size("scopes").cast("bigint").alias("n_scopes"))


@register("assign_seq", ev_sql("SELECT he_block, tx_seq, tx_id FROM ev"))
def q_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based position of each kept activity row within its block."""
    return parse.nft_events(fx_parsed(spark, sf_dir)).select("he_block", "tx_seq", "tx_id")


@register("burned", with_ctes(CATALOG_SNAP_SQL, "fx_collections", body="""
SELECT symbol, CAST(supply AS DOUBLE) AS supply, CAST(circulating_supply AS DOUBLE) AS circulating_supply,
       CAST(supply - circulating_supply AS DOUBLE) AS burned FROM (
  SELECT symbol, supply, circulating_supply FROM fx_collections WHERE symbol NOT IN (SELECT symbol FROM snap)
  UNION ALL SELECT symbol, supply, circulating_supply FROM snap) t"""))
def q_burned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B19 over the catalog after the sweep: supply - circulating, NULL unless
    both are known."""
    from ...functions import burned
    c = upserted_catalog(spark, sf_dir)
    return nullable_counts_as_double(c.select("symbol", "supply", "circulating_supply", burned().alias("burned")),
                                     "supply", "circulating_supply", "burned")


@register("normalize_orders", fx.with_fixtures("""
SELECT symbol, nft_id, account, owned_by, CAST(price AS DOUBLE) AS price, price_symbol, grouping_key AS grouping, ts
FROM fx_orders""", "fx_orders"))
def q_normalize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sell-order records as a node sends them (nftId and price as text,
    epoch-ms timestamp, grouping as an object or absent) -> typed rows."""
    from ...schemas import ORDER_RAW_DDL
    from ...sources.snapshots import normalize_orders
    o = fx.fx_orders(spark, sf_dir)
    rec = F.to_json(F.struct(
        "symbol", F.col("nft_id").cast("string").alias("nftId"), "account", F.col("owned_by").alias("ownedBy"),
        F.col("price").cast("decimal(18,2)").cast("string").alias("price"), F.col("price_symbol").alias("priceSymbol"),
        (F.unix_micros("ts") / 1000).cast("bigint").alias("timestamp"),
        F.when(F.col("grouping_key") != "{}", F.col("grouping_key")).alias("grouping")))
    raw = o.select(F.from_json(rec, ORDER_RAW_DDL).alias("r")).select("r.*")
    n = normalize_orders(raw)
    return comparable(n.select("symbol", "nft_id", "account", "owned_by", "price", "price_symbol", "grouping", "ts"))


@register("read_blocks", ev_sql("""
SELECT he_block, bts AS ts, CAST(COUNT(*) + 1 + CASE WHEN he_block % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_tx
FROM ev GROUP BY he_block, bts"""))
def q_read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 (batch): block documents landed as JSON-lines files, read back with
    the block reader."""
    from ...streaming import capture
    root = fresh_dir(spark, "landed-blocks")
    fx.fx_block_docs(spark, sf_dir).select("value").write.text(root)
    b = capture.read_blocks(spark, root)
    return parse.typed_blocks(b).select("he_block", "ts", F.size("txs").alias("n_tx"))


# event_id % 5: an object, the same object inside a JSON string, cut text, no text, an array
@register("json_or_default", fx.with_fixtures("""
SELECT he_block, tx_seq, CASE WHEN (he_block * 10 + tx_seq) % 5 < 2 THEN CAST(nft_id AS DOUBLE) END AS n,
       CASE WHEN (he_block * 10 + tx_seq) % 5 < 2 THEN symbol ELSE 'none' END AS s FROM fx_events""", "fx_events"))
def q_json_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: a landed field that arrives as an object or as a JSON string, and a default where it is bad or missing."""
    from ...functions import json_or_default
    e = fx.fx_events(spark, sf_dir)
    kind = (F.col("he_block") * 10 + F.col("tx_seq")) % 5
    obj = F.to_json(F.struct(F.col("nft_id").alias("n"), F.col("symbol").alias("s")))
    quoted = F.to_json(F.struct(obj.alias("x")))       # {"x":"{\\"n\\":...}"}
    field = (F.when(kind == 0, F.concat(F.lit('{"x":'), obj, F.lit("}"))).when(kind == 1, quoted)
             .when(kind == 2, F.lit('{"x":"{\\"n\\":"}')).when(kind == 3, F.lit("{}")).otherwise(F.lit('{"x":[1]}')))
    landed = e.select("he_block", "tx_seq", F.from_json(field, "x string")["x"].alias("x"))
    none = F.struct(F.lit(None).cast("bigint").alias("n"), F.lit("none").alias("s"))
    read = json_or_default("x", "n bigint, s string")
    whole = F.when(read["s"].isNotNull(), read)     # cut text and arrays give a struct of nulls, not NULL
    return nullable_counts_as_double(landed.select("he_block", "tx_seq", F.coalesce(whole, none).alias("r")).select(
        "he_block", "tx_seq", "r.n", "r.s"), "n")


# -- A3: records and outcomes of holding fetches, as landed files -----------------

@register("read_holding_snapshots", with_ctes(_HOLD_SQL.replace(
    ") s WHERE (ck + nk) % 3 <> 0)", ") s WHERE (ck + nk) % 3 <> 0 AND (ck + nk) % 7 <> 3)"), "fx_holdings", body="""
SELECT symbol, nft_id, account, owned_by, delegated_to, properties, refreshed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, nft_id ORDER BY refreshed_at DESC, src DESC) AS rn FROM allrows) t
WHERE rn = 1"""))
def q_read_holding_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: records and outcomes land as files; fetches that failed or were cut short say nothing about their scopes. Read,
    normalized and applied to the whole table."""
    from ...operators import state
    from ...sources.snapshots import normalize_holdings, read_holding_snapshots
    root = fresh_dir(spark, "holding-fetches")
    fetched, outcomes = _holding_fixture(spark, sf_dir)
    record = F.to_json(F.struct("symbol", F.col("nft_id").alias("_id"), "account", F.col("owned_by").alias("ownedBy"),
                                F.col("delegated_to").alias("delegatedTo"), "properties",
                                F.date_format("refreshed_at", "yyyy-MM-dd HH:mm:ss").alias("fetchedAt")))
    fetched.select(record.alias("value")).write.text(f"{root}/records")
    number = lambda c, at: F.substring(c, at, 32).cast("bigint")
    cut = (number(F.col("account"), 5) + number(F.col("symbol"), 4)) % 7 == 3
    outcomes.withColumn("complete", ~cut).write.json(f"{root}/outcomes")
    raw, outcomes = read_holding_snapshots(spark, f"{root}/records", f"{root}/outcomes")
    records = normalize_holdings(raw, keep=("fetched_at",)).select(
        "symbol", "nft_id", "account", "owned_by", "delegated_to", "properties", F.col("fetched_at").alias("refreshed_at"))
    return state.apply_holdings(fx.fx_holdings(spark, sf_dir), records, outcomes)
