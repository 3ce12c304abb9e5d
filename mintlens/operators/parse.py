"""Block parsing: landed block documents -> activity feed, completed sales,
touched scopes, unknown event names (B5-B15).

Design: a block is one row, and everything that needs block order (the
per-block event sequence, per-transaction coverage of touched accounts) is
computed *inside that row* with higher-order array functions (``transform``,
``filter``, ``exists``, ``flatten``) before a single ``posexplode``. No
window, no shuffle: the parse is a map-only stage whose cost is linear in the
landed bytes, and a block's events never leave the task that read it.

Nothing here derives holdings: the outputs only say what a block reported
and whom to re-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import NFT_CONTRACTS, block_ts, first_present, first_truthy, json_map, price, strict_id
from ..schemas import BLOCK_DDL, EVENT_DDL, LOGS_DDL, SELLERS_DDL, TX_DDL

# Emitted nft/nftmarket event name -> activity op label.
EVENT_OPS = {
    "issue": "issue",
    "transfer": "transfer",
    "burn": "burn",
    "delegate": "delegate",
    "undelegate": "undelegate",
    "undelegateStart": "undelegate_start",
    "undelegateDone": "undelegate_done",
    "sellOrder": "market_list",
    "cancelOrder": "market_cancel",
    "changePrice": "market_price_change",
}

# nft/nftmarket event names that are known and not activity.
NON_ACTIVITY_EVENTS = (
    "create", "updateUrl", "updateMetadata", "updateName", "updateOrgName",
    "updateProductName", "addProperty", "setProperties", "setGroupBy",
    "setPropertyPermissions", "updatePropertyDefinition", "enableDelegation",
    "setUndelegationCooldown", "addAuthorizedIssuingAccounts",
    "addAuthorizedIssuingContracts", "removeAuthorizedIssuingAccounts",
    "removeAuthorizedIssuingContracts", "transferOwnership", "enableMarket",
    "setMarketParams", "hitSellOrder",
)

# Keys whose string value names an account, at any depth.
ACCOUNT_KEYS = ("account", "to", "from", "counterparty", "issuer")
# A member of an object in canonical JSON text. There a quote after a brace or comma begins a key or a string, never lies
# inside one (it would follow a backslash), and only a key is followed by a colon. Possessive and unrolled: no
# backtracking and no recursion, whatever the length of a value.
ACCOUNT_FIELD_PATTERN = r'[{,]"(?:' + "|".join(ACCOUNT_KEYS) + r')":"([^"\\]*+(?:\\.[^"\\]*+)*+)"'

MARKET_BUY_EVENT = "hitSellOrder"


# -- A1 (document form) / B5 / B6 ---------------------------------------------

def blocks_from_json(docs: DataFrame, text_col: str = "value", ingest_ts: Column | None = None) -> DataFrame:
    """Block documents held as JSON text (one per row) -> typed blocks."""
    ingest = ingest_ts if ingest_ts is not None else F.lit(None).cast("timestamp")
    return (docs.select(F.from_json(F.col(text_col), BLOCK_DDL).alias("b"), ingest.alias("ingest_ts"))
            .select("b.*", "ingest_ts"))


def judged_documents(docs: DataFrame, text_col: str = "value", file_col: str | None = None,
                     ingest_ts: Column | None = None) -> DataFrame:
    """The one rule for landed text: (file, raw, reason, and the columns of a block). A document without a reason is a
    block; one with a reason cannot be (it is not a JSON object, or has no integer block number). Blank lines
    are no documents."""
    text = F.col(text_col)
    file = F.col(file_col) if file_col else F.lit(None).cast("string")
    ingest = ingest_ts if ingest_ts is not None else F.lit(None).cast("timestamp")
    docs = docs.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    read = docs.select(file.alias("file"), text.alias("raw"), F.from_json(text, BLOCK_DDL).alias("b"), ingest.alias("ingest_ts"))
    # JSON that begins with a brace is an object: its schema need not be built
    is_object = F.try_parse_json("raw").isNotNull() & F.ltrim("raw", F.lit(" \t\r\n")).startswith("{")
    reason = F.when(~is_object, "not a JSON object").when(F.col("b.blockNumber").isNull(), "no block number")
    return read.select("file", "raw", reason.alias("reason"), "b.*", "ingest_ts")


def unusable_documents(docs: DataFrame, text_col: str = "value", file_col: str | None = None) -> DataFrame:
    """Documents that cannot become a block, with the reason. They are kept as they landed, never skipped."""
    return judged_documents(docs, text_col, file_col).where(F.col("reason").isNotNull()).select("file", "raw", "reason")


def usable_blocks(docs: DataFrame, text_col: str = "value", ingest_ts: Column | None = None) -> DataFrame:
    """The typed blocks among landed documents: exactly those that are not unusable."""
    return judged_documents(docs, text_col, None, ingest_ts).where(F.col("reason").isNull()).drop("file", "raw", "reason")


def _ops_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in EVENT_OPS.items() for x in kv])


def _is_nft(c: Column) -> Column:
    return F.coalesce(c.isin(*NFT_CONTRACTS), F.lit(False))


def typed_blocks(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """B5 + B6 inside the row: block number, block time, and the transactions
    with their logs parsed once (dual encoding; malformed logs -> no events)
    and their position kept. Each event's data is parsed to a map once here
    (and a hitSellOrder's sellers list once), so later steps only look up
    fields. One row per block; ``keep`` names further columns to carry along."""
    ingest = F.col("ingest_ts") if "ingest_ts" in blocks.columns else F.lit(None).cast("timestamp")
    if "ingestTs" in blocks.columns:
        ingest = F.coalesce(F.col("ingestTs").try_cast("timestamp"), ingest)

    def event(e):
        # the map is bound once for both uses, so the transactions are not walked again for the sellers
        return F.transform(F.array(json_map(e["data"])), lambda d: F.struct(
            e["contract"].alias("contract"), e["event"].alias("event"), e["data"].alias("data"), d.alias("d"),
            F.when(e["event"] == MARKET_BUY_EVENT, F.from_json(d["sellers"], SELLERS_DDL)).alias("sellers")))[0]

    txs = F.transform(F.coalesce(F.col("transactions"), _empty(TX_DDL)), lambda t, i: F.struct(
        i.alias("tx_pos"), t["contract"].alias("contract"), t["action"].alias("action"),
        t["sender"].alias("sender"), t["transactionId"].alias("tx_id"), t["payload"].alias("payload"),
        F.transform(F.coalesce(F.from_json(t["logs"], LOGS_DDL)["events"], _empty(EVENT_DDL)), event).alias("events")))
    return blocks.select(F.col("blockNumber").alias("he_block"),
                         block_ts(F.col("timestamp"), ingest).alias("ts"), *keep, txs.alias("txs"))


def explode_tx(blocks: DataFrame) -> DataFrame:
    """One row per transaction, with its position in the block."""
    t = typed_blocks(blocks)
    return (t.select("he_block", "ts", F.explode_outer("txs").alias("tx")).where(F.col("tx").isNotNull())
            .select("he_block", "ts", "tx.*"))


def _has_nft_activity(tx: Column) -> Column:
    """An item contract is called directly, or emits something in a transaction of another contract."""
    return _is_nft(tx["contract"]) | F.exists(tx["events"], lambda e: _is_nft(e["contract"]))


def nft_activity(blocks: DataFrame) -> DataFrame:
    """B7 as a frame: the transactions that touch NFTs at all."""
    tx = explode_tx(blocks)
    return tx.where(_is_nft(F.col("contract")) | F.exists("events", lambda e: _is_nft(e["contract"])))


# -- B8 / B9: activity rows per transaction ----------------------------------

_ROW_FIELDS = ("symbol", "nft_id", "op", "account", "counterparty", "price_raw", "price_symbol", "tx_id")


def _row(symbol, nft_id, op, account, counterparty, price_raw, price_symbol, tx_id) -> Column:
    vals = (symbol, nft_id, op, account, counterparty, price_raw, price_symbol, tx_id)
    return F.struct(*[v.cast("bigint" if n == "nft_id" else "string").alias(n)
                      for n, v in zip(_ROW_FIELDS, vals)])


ROW_T = ("struct<symbol:string,nft_id:bigint,op:string,account:string,counterparty:string,"
         "price_raw:string,price_symbol:string,tx_id:string>")
SALE_T = ("struct<symbol:string,id_raw:string,price_raw:string,price_symbol:string,seller:string,"
          "buyer:string,tx_id:string>")


def _empty(elem_type: str) -> Column:
    return F.array().cast(f"array<{elem_type}>")


def _buy_rows(tx: Column, e: Column, kind: str) -> Column:
    """One row per (seller, sale) of a hitSellOrder event, encounter order."""
    d, sellers = e["d"], e["sellers"]
    symbol = d["symbol"]
    buyer = d["account"]

    def sale_row(s, sale):
        token = first_truthy(sale["symbol"], d["priceSymbol"])
        if kind == "activity":
            return _row(symbol, strict_id(sale["id"]), F.lit("market_buy"), buyer, s["account"],
                        sale["price"], token, tx["tx_id"])
        return F.struct(symbol.alias("symbol"), sale["id"].alias("id_raw"), sale["price"].alias("price_raw"),
                        token.alias("price_symbol"), s["account"].alias("seller"), buyer.alias("buyer"),
                        tx["tx_id"].alias("tx_id"))

    rows = F.flatten(F.transform(sellers, lambda s: F.transform(
        F.coalesce(s["nftSales"], _empty("map<string,string>")), lambda sale: sale_row(s, sale))))
    return rows


def _event_rows(tx: Column, e: Column) -> Column:
    """Activity rows of one nft-contract event (empty when not activity or
    when symbol / integer id are missing)."""
    d = e["d"]
    name = e["event"]
    simple = _row(d["symbol"], strict_id(first_present(d, "id", "nftId")), _ops_map()[name],
                  first_truthy(d["from"], d["account"]), d["to"],
                  first_present(d, "price", "newPrice"), d["priceSymbol"], tx["tx_id"])
    simple_arr = F.filter(F.array(simple), lambda r: r["op"].isNotNull() & r["symbol"].isNotNull()
                          & r["nft_id"].isNotNull())
    buys = F.filter(F.coalesce(_buy_rows(tx, e, "activity"), _empty(ROW_T)),
                    lambda r: r["symbol"].isNotNull() & r["nft_id"].isNotNull())
    return F.when(name == MARKET_BUY_EVENT, buys).otherwise(simple_arr)


def _tx_rows(tx: Column) -> Column:
    return F.flatten(F.transform(F.filter(tx["events"], lambda e: _is_nft(e["contract"])),
                                 lambda e: _event_rows(tx, e)))


# -- B12 / B13: who to re-check ---------------------------------------------

def _scan_accounts(j: Column) -> Column:
    """B12 for one JSON text: every string under an account key at any depth, unescaped.

    The parsed value is written out again, once, in canonical form: keys unescaped, the last of repeated keys
    only, no blanks. Its account members are then exactly the matches of ``ACCOUNT_FIELD_PATTERN``, however
    deep they lie, without a recursion over levels (a job each) or a shuffle. Invalid JSON -> nothing.
    A text without a backslash spells its keys as they are: if it has no account key, it is not parsed."""
    may_name = j.contains("\\")
    for key in ACCOUNT_KEYS:
        may_name = may_name | j.contains(f'"{key}"')
    canonical = F.when(may_name, F.to_json(F.try_parse_json(j)))
    raw = F.regexp_extract_all(canonical, F.lit(ACCOUNT_FIELD_PATTERN), 1)
    vals = F.transform(raw, lambda r: F.when(~r.contains("\\"), r).otherwise(      # nothing to unescape in most
        F.from_json(F.concat(F.lit('["'), r, F.lit('"]')), "array<string>")[0]))
    return F.coalesce(vals, F.array().cast("array<string>"))


def _tx_touched(tx: Column) -> Column:
    """Sender + account fields of every event's data (any contract) + payload."""
    parts = F.flatten(F.array(F.array(tx["sender"]),
                              F.flatten(F.transform(tx["events"], lambda e: _scan_accounts(e["data"]))),
                              _scan_accounts(tx["payload"])))
    return F.array_distinct(F.filter(parts, lambda a: a.isNotNull() & (a != "")))


def _tx_scopes(tx: Column, rows: Column) -> Column:
    """B13 for one transaction: (account, symbol) for accounts an event names
    together with a symbol; (account, '') for the other touched accounts."""
    pair_t = "struct<account:string,symbol:string>"
    named = F.filter(F.flatten(F.transform(rows, lambda r: F.array(
        F.struct(r["account"].alias("account"), r["symbol"].alias("symbol")),
        F.struct(r["counterparty"].alias("account"), r["symbol"].alias("symbol"))))),
        lambda p: F.coalesce(p["account"] != "", F.lit(False)) & F.coalesce(p["symbol"] != "", F.lit(False)))

    def scopes(targeted):
        rest = F.transform(F.array_except(_tx_touched(tx), targeted["account"]),
                           lambda a: F.struct(a.alias("account"), F.lit("").alias("symbol")))
        return F.flatten(F.array(targeted, rest.cast(f"array<{pair_t}>")))
    return F.transform(F.array(named.cast(f"array<{pair_t}>")), scopes)[0]


# -- B14: one pass, three outputs ---------------------------------------------

def parse_blocks(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per block with three arrays -- activity rows in encounter
    order (their index is tx_seq, B11), completed-sale rows, and distinct
    touched scopes -- plus the unknown nft event names. Feeds
    :func:`nft_events`, :func:`market_sales`, :func:`touch_scopes` and
    :func:`unknown_events`; cache it when several outputs are taken."""
    # a block without a number cannot be keyed: it yields no rows (arrays empty)
    t = typed_blocks(blocks, keep).select("he_block", "ts", *keep, F.filter(
        F.when(F.col("he_block").isNotNull(), F.col("txs")), _has_nft_activity).alias("txs"))
    with_rows = F.transform("txs", lambda tx: F.struct(tx.alias("tx"), _tx_rows(tx).alias("rows")))
    return (t.select("he_block", "ts", *keep, with_rows.alias("w"))
            .select(
                "he_block", "ts", *keep,
                F.flatten(F.transform("w", lambda x: x["rows"])).alias("events"),
                F.flatten(F.transform("w", lambda x: _tx_sales(x["tx"]))).alias("sales"),
                F.array_distinct(F.flatten(F.transform("w", lambda x: _tx_scopes(x["tx"], x["rows"])))).alias("scopes"),
                F.flatten(F.transform("w", lambda x: F.transform(
                    F.filter(x["tx"]["events"], lambda e: _is_nft(e["contract"]) & _unknown_name(e["event"])),
                    lambda e: e["event"]))).alias("unknown")))


def _unknown_name(name: Column) -> Column:
    known = list(EVENT_OPS) + list(NON_ACTIVITY_EVENTS)
    return name.isNotNull() & (name != "") & ~name.isin(*known)


def _tx_sales(tx: Column) -> Column:
    """B10 rows of one transaction: only an nftmarket ``buy`` transaction's
    hitSellOrder events; sales without id or price are skipped."""
    is_buy = F.coalesce((tx["contract"] == "nftmarket") & (tx["action"] == "buy"), F.lit(False))
    rows = F.flatten(F.transform(F.filter(tx["events"], lambda e: F.coalesce(e["event"] == MARKET_BUY_EVENT, F.lit(False))),
                                 lambda e: F.coalesce(_buy_rows(tx, e, "sale"), _empty(SALE_T))))
    kept = F.filter(rows, lambda r: r["id_raw"].isNotNull() & r["price_raw"].isNotNull())
    return F.when(is_buy, kept).otherwise(_empty(SALE_T))


def nft_events(parsed: DataFrame) -> DataFrame:
    """B8 + B11: the activity feed, tx_seq = 0-based position in the block
    among the kept rows."""
    return (parsed.select("he_block", "ts", F.posexplode_outer("events").alias("tx_seq", "e"))
            .where(F.col("e").isNotNull())
            .select("he_block", F.col("tx_seq").cast("int").alias("tx_seq"), "e.symbol", "e.nft_id", "e.op",
                    "e.account", "e.counterparty", price(F.col("e.price_raw")).alias("price"),
                    "e.price_symbol", "e.tx_id", "ts"))


def _sales_exploded(parsed: DataFrame) -> DataFrame:
    s = parsed.select("he_block", "ts", F.posexplode_outer("sales").alias("sale_pos", "s")).where(F.col("s").isNotNull())
    return s.select("sale_pos", "s.symbol", strict_id(F.col("s.id_raw")).alias("nft_id"), price(F.col("s.price_raw")).alias("price"),
                    "s.price_symbol", "s.seller", "s.buyer", "he_block", "ts", "s.id_raw", "s.price_raw", "s.tx_id")


def _sale_ok() -> Column:
    return (F.col("symbol").isNotNull() & F.col("nft_id").isNotNull() & F.col("price").isNotNull()
            & F.col("price_symbol").isNotNull() & F.col("seller").isNotNull() & F.col("buyer").isNotNull()
            & F.col("he_block").isNotNull())


def market_sales(parsed: DataFrame, with_pos: bool = False) -> DataFrame:
    """Completed sales, one row per instance sold. ``with_pos`` adds ``sale_pos``,
    the sale's place in its block: of two sales of one instance in a block the first counts."""
    return (_sales_exploded(parsed).where(_sale_ok())
            .select(*(["sale_pos"] if with_pos else []), "symbol", "nft_id", "price", "price_symbol", "seller", "buyer", "he_block", "ts"))


def sales_quarantine(parsed: DataFrame) -> DataFrame:
    """Sale rows the sink would reject (bad id or price, missing symbol,
    seller, buyer or token), kept with their raw values instead of stalling."""
    return _sales_exploded(parsed).where(~_sale_ok())


def price_quarantine(parsed: DataFrame) -> DataFrame:
    """Activity rows whose price is not a DECIMAL(38,18) (too large, or no number), with the raw text. The rows stay in the
    feed with price NULL."""
    return (parsed.select("he_block", "ts", F.posexplode_outer("events").alias("tx_seq", "e"))
            .where(F.col("e.price_raw").isNotNull() & price(F.col("e.price_raw")).isNull())
            .select("he_block", F.col("tx_seq").cast("int").alias("tx_seq"), "e.symbol", "e.nft_id", "e.op", "e.price_raw",
                    "e.price_symbol", "e.tx_id", "ts"))


def market_buys(parsed: DataFrame) -> DataFrame:
    """The market_buy rows of the activity feed."""
    return nft_events(parsed).where(F.col("op") == "market_buy")


def touch_scopes(parsed: DataFrame) -> DataFrame:
    """Distinct (account, symbol) scopes touched per block ('' = whole
    account), with the block time as the touch time."""
    return (parsed.select("he_block", "ts", F.explode_outer("scopes").alias("p"))
            .where(F.col("p").isNotNull())
            .select("he_block", "p.account", "p.symbol", F.col("ts").alias("touched_at")))


def touched_accounts(blocks: DataFrame) -> DataFrame:
    """The accounts that each item transaction names anywhere."""
    tx = explode_tx(blocks)
    tx = tx.where(_is_nft(F.col("contract")) | F.exists("events", lambda e: _is_nft(e["contract"])))
    st = F.struct(*[F.col(c) for c in ("tx_pos", "contract", "action", "sender", "tx_id", "payload", "events")])
    return (tx.select("he_block", "tx_pos", "tx_id", F.explode_outer(_tx_touched(st)).alias("account"))
            .where(F.col("account").isNotNull()))


def unknown_events(parsed: DataFrame) -> DataFrame:
    """Nft-contract event names outside both known lists, with how often
    and in which block range they were seen (the parser-review alarm)."""
    return (parsed.select("he_block", F.explode_outer("unknown").alias("event"))
            .where(F.col("event").isNotNull())
            .groupBy("event")
            .agg(F.count(F.lit(1)).alias("n"), F.min("he_block").alias("first_block"),
                 F.max("he_block").alias("last_block")))


def market_symbols(events: DataFrame) -> DataFrame:
    """Symbols with a live market event (op market_*), with the latest time."""
    return (events.where(F.col("op").startswith("market_") & F.col("symbol").isNotNull())
            .groupBy("symbol").agg(F.max("ts").alias("flagged_at")))
