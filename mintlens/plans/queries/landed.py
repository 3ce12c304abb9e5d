"""Landed snapshot files: holdings (A3, B3), catalog (A2), books (A4), rule versions (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import state
from ...sources import fixtures as fx
from .common import ORACLE, comparable, fresh_dir, nullable_counts_as_double, register
from .snapshots import book_fixture, catalog_snapshot_raw


# -- landed snapshot files (A2-A5, B3) -------------------------------------------

def _holding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding records as a node returns them: ``_id`` as number, delegation
    as an object in even keys and a plain string in odd ones, soulbound under
    either spelling, properties as an object."""
    h = fx.fx_holdings(spark, sf_dir)
    k = F.col("nft_id")
    deleg_obj = F.to_json(F.struct(F.col("delegated_to").alias("account"), F.lit("u").alias("ownedBy")))
    base = F.to_json(F.struct(
        "symbol", k.alias("_id"), "account", F.col("owned_by").alias("ownedBy"),
        F.when(F.col("delegated_to").isNotNull(),
               F.when(k % 2 == 0, deleg_obj).otherwise(F.col("delegated_to"))).alias("delegatedTo"),
        F.col("properties").alias("properties")))
    # the two spellings of the soulbound flag are distinct JSON keys
    soul = F.concat_ws(",", F.when(k % 11 == 0, F.lit('"soulbound":true')),
                       F.when(k % 13 == 0, F.lit('"soulBound":"yes"')))
    rec = F.when(soul != "", F.concat(F.lit("{"), soul, F.lit(","), F.substring(base, 2, 1 << 30))).otherwise(base)
    return h.select(rec.alias("value"))


@register("normalize_holdings", fx.with_fixtures("""
SELECT symbol, nft_id, account, owned_by, delegated_to,
       CASE WHEN delegated_to IS NOT NULL AND nft_id % 2 = 0 THEN 'u' END AS delegated_to_type,
       nft_id % 11 = 0 OR nft_id % 13 = 0 AS soul_bound, properties
FROM fx_holdings""", "fx_holdings"))
def q_normalize_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 over landed records (A3): written as JSON lines, read back with the
    snapshot reader, normalized."""
    from ...sources.snapshots import normalize_holdings, read_holding_snapshots
    root = fresh_dir(spark, "holding-snapshots")
    _holding_records(spark, sf_dir).write.text(f"{root}/records")
    spark.createDataFrame([], "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp") \
        .write.json(f"{root}/outcomes")
    raw, _ = read_holding_snapshots(spark, f"{root}/records", f"{root}/outcomes")
    # properties arrive as an object; the reader keeps their JSON text (re-serialized compactly)
    return normalize_holdings(raw).select("symbol", "nft_id", "account", "owned_by", "delegated_to",
                                          "delegated_to_type", "soul_bound", "properties")


@register("read_catalog", ORACLE["normalize_catalog"])
def q_landed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + B2 from files: the catalog snapshot landed as JSON lines."""
    from ...sources.snapshots import normalize_catalog, read_catalog
    root = fresh_dir(spark, "catalog-snapshot")
    raw = catalog_snapshot_raw(spark, sf_dir)
    raw.select(F.to_json(F.struct(*raw.columns)).alias("value")).write.text(root)
    return nullable_counts_as_double(normalize_catalog(read_catalog(spark, root)).select(
        "symbol", "name", "org_name", "supply", "circulating_supply", "max_supply", "url"),
        "supply", "circulating_supply", "max_supply")


@register("read_book_snapshots", ORACLE["apply_book"])
def q_landed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + B4 + C4 from files: sell-book records and per-symbol outcomes
    landed as JSON lines, read back, normalized and applied."""
    from ...sources.snapshots import normalize_orders, read_book_snapshots
    root = fresh_dir(spark, "book-snapshot")
    orders, outcomes = book_fixture(spark, sf_dir)
    rec = F.to_json(F.struct("symbol", F.col("nft_id").cast("string").alias("nftId"), "account",
                             F.col("price").cast("string").alias("price"), F.col("price_symbol").alias("priceSymbol"),
                             (F.unix_micros("ts") / 1000).cast("bigint").alias("timestamp"),
                             F.when(F.col("grouping_key") != "{}", F.col("grouping_key")).alias("grouping"), "pos"))
    orders.select(rec.alias("value")).write.text(f"{root}/orders")
    outcomes.write.json(f"{root}/outcomes")
    raw, outc = read_book_snapshots(spark, f"{root}/orders", f"{root}/outcomes")
    book = (normalize_orders(raw, keep=("pos",))
            .select("symbol", "nft_id", "account", "owned_by", "price", "price_symbol",
                    F.col("grouping").alias("grouping_key"), "ts", "pos"))
    return comparable(state.apply_book(fx.fx_orders(spark, sf_dir), book, outc))


@register("read_mappings", fx.with_fixtures("""
SELECT symbol, version, mapping FROM fx_mappings
UNION ALL
SELECT 'SYM' || CAST(p_partkey % 25 AS VARCHAR), CAST(p_partkey AS INTEGER) + 100000,
       '{"name":{"template":"{symbol} #{nft_id}"}}'
FROM part WHERE p_partkey % 25 BETWEEN 10 AND 12""", "fx_mappings"))
def q_add_mapping_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a rule file brings new versions for SYM10..12 and re-sends every
    existing version with different text; existing versions stay."""
    from ...sources.snapshots import add_mapping_versions, read_mappings
    root = fresh_dir(spark, "rules")
    cur = fx.fx_mappings(spark, sf_dir)
    p = fx.table(spark, sf_dir, "part").select("p_partkey")
    pk = F.col("p_partkey")
    new = p.where((pk % 25 >= 10) & (pk % 25 <= 12)).select(
        F.concat(F.lit("SYM"), (pk % 25).cast("string")).alias("symbol"), (pk.cast("int") + 100000).alias("version"),
        F.lit('{"name":{"template":"{symbol} #{nft_id}"}}').alias("mapping"))
    resent = cur.select("symbol", "version", F.lit('{"name":{"from":"symbol"}}').alias("mapping"))
    new.unionByName(resent).write.json(root)
    return add_mapping_versions(cur, read_mappings(spark, root))
