"""Landed current-state snapshots: catalog rows, holdings per (account, symbol)
fetch, sell books per symbol (A2-A4), and their normalizers (B2-B4).

Snapshots land as JSON lines, one record per line, next to an outcome file
that says for every fetched scope whether the fetch succeeded and whether it
was complete. Every field is read as text and typed here, so nodes that send
numbers as strings or objects as JSON strings parse the same way; nothing is
paged or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_ms_ts, json_map, json_or_default, price, strict_id, truthy
from ..schemas import CATALOG_RAW_DDL, HOLDING_RAW_DDL, ORDER_RAW_DDL, OUTCOME_DDL


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A2: the whole catalog as landed records (normalize with B2)."""
    return _read(spark, path, CATALOG_RAW_DDL)


def read_holding_snapshots(spark: SparkSession, path: str, outcomes_path: str) -> tuple[DataFrame, DataFrame]:
    """A3: fetched holding records and the per-scope outcomes
    (account, symbol, ok, complete, fetched_at). The record schema has two
    keys that differ only in letter case (soulbound / soulBound), which a
    file-source schema rejects, so the lines are parsed with ``from_json``."""
    recs = spark.read.text(path).select(F.from_json("value", HOLDING_RAW_DDL).alias("r")).select("r.*")
    return recs, _read(spark, outcomes_path, OUTCOME_DDL)


def read_book_snapshots(spark: SparkSession, path: str, outcomes_path: str) -> tuple[DataFrame, DataFrame]:
    """A4: open sell orders per symbol (no page cap) and per-symbol outcomes."""
    return _read(spark, path, ORDER_RAW_DDL), _read(spark, outcomes_path, OUTCOME_DDL)


def _extra(keep: tuple[str, ...]) -> list[F.Column]:
    """Further columns of a landed record: its position in the snapshot (``pos``), the time of the fetch
    it belongs to (``fetched_at``), or any other as it is."""
    typed = {"pos": strict_id("pos").alias("pos"), "fetched_at": F.col("fetchedAt").try_cast("timestamp").alias("fetched_at")}
    return [typed.get(k, F.col(k)) for k in keep]


def _json_text(c, default: str) -> F.Column:
    """Keep JSON text when it parses (object or array per ``default``), else
    the default (dual encoding, B1)."""
    ddl = "map<string,string>" if default == "{}" else "array<string>"
    return F.when(F.from_json(F.col(c), ddl).isNotNull(), F.col(c)).otherwise(F.lit(default))


def normalize_catalog(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """B2: camelCase -> columns; url from metadata; maxSupply 0 -> NULL; bool
    flags by truthiness. ``market_enabled`` is not taken from the catalog
    (L6): it is derived from the book (C5). ``keep`` passes extra columns."""
    meta = json_map("metadata")
    return raw.select(*_extra(keep),
        "symbol", "name", F.col("orgName").alias("org_name"), F.col("productName").alias("product_name"),
        "issuer", meta["url"].alias("url"), _json_text("metadata", "{}").alias("metadata"),
        json_or_default("groupBy", "array<string>", F.array().cast("array<string>")).alias("group_by"),
        _json_text("properties", "{}").alias("properties"),
        truthy("delegationEnabled").alias("delegation_enabled"),
        strict_id("supply").alias("supply"), strict_id("circulatingSupply").alias("circulating_supply"),
        F.nullif(strict_id("maxSupply"), F.lit(0).cast("bigint")).alias("max_supply"),
        strict_id("undelegationCooldown").cast("int").alias("undelegation_cooldown_days"))


def normalize_holdings(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_id`` -> nft_id; ownedBy default 'u'; delegatedTo as an object
    ({account, ownedBy}) or a plain string; soulbound under either spelling;
    properties parsed (default ``{}``). ``keep`` passes extra columns (e.g. ``fetched_at``)."""
    # the two spellings differ only in letter case: rename by position first
    raw = raw.toDF(*["soulBound_camel" if c == "soulBound" else c for c in raw.columns])
    d = F.col("delegatedTo")
    deleg = F.from_json(d, "map<string,string>")
    is_obj = deleg.isNotNull()
    return raw.select(*_extra(keep),
        "symbol", strict_id("_id").alias("nft_id"), "account",
        F.coalesce(F.col("ownedBy"), F.lit("u")).alias("owned_by"),
        F.when(is_obj, deleg["account"]).otherwise(d).alias("delegated_to"),
        F.when(is_obj, deleg["ownedBy"]).otherwise(F.col("delegatedToType")).alias("delegated_to_type"),
        (truthy("soulbound") | truthy("soulBound_camel")).alias("soul_bound"),
        _json_text("properties", "{}").alias("properties"))


def normalize_orders(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """nftId -> bigint, price -> decimal, epoch-ms -> timestamp, grouping
    default ``{}``. ``keep`` passes extra columns through (e.g. page position)."""
    g = F.col("grouping")
    return raw.select(*_extra(keep),
        "symbol", strict_id("nftId").alias("nft_id"), "account",
        F.coalesce(F.col("ownedBy"), F.lit("u")).alias("owned_by"),
        price("price").alias("price"), F.col("priceSymbol").alias("price_symbol"),
        price("fee").alias("fee"), epoch_ms_ts("timestamp").alias("ts"),
        F.when(F.from_json(g, "map<string,string>").isNotNull(), g).otherwise(F.lit("{}")).alias("grouping"))


MAPPING_DDL = "symbol string, version int, mapping string"


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """A5: display-rule rows (symbol, version, mapping JSON text)."""
    return _read(spark, path, MAPPING_DDL)


def add_mapping_versions(cur: DataFrame, new: DataFrame) -> DataFrame:
    """A5: rules are append-only versions -- new (symbol, version) rows are
    added, an existing (symbol, version) is kept as it is."""
    # copies of a version that differ: the least text wins, on every run
    fresh = new.groupBy("symbol", "version").agg(F.min("mapping").alias("mapping")).join(
        cur.select("symbol", "version"), ["symbol", "version"], "left_anti")
    return cur.unionByName(fresh.select(*cur.columns))
