"""Read views over the mirrored tables.

Views are computed for all accounts / symbols in bulk (or for a requested
set given as a frame), not one request at a time. All joins are equi-joins; which side to
broadcast is left to the planner and AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import burned
from .pages import activity_cursor, keyset_page, page_params, parse_activity_cursor

# Fixed value: nested wallet pages hold the items of one id range of this width.
WALLET_ID_RANGE = 1000
# Columns of the normalized inputs that views carry where the input has them.
ITEM_EXTRAS = ("delegated_to_type", "soul_bound")
ORDER_EXTRAS = ("fee",)


def retry_stats(pending: DataFrame) -> DataFrame:
    """Pending retries (scopes that failed at least once since their last
    success): how many, the worst attempt count, the next retry time."""
    return (pending.where(F.col("attempts") > 0)
            .agg(F.count(F.lit(1)).alias("pending"), F.max("attempts").alias("max_attempts"),
                 F.min("not_before").alias("next_retry_at")))


def _coll_names(collections: DataFrame) -> DataFrame:
    return collections.select("symbol", F.col("name").alias("collection_name"))


def wallet_sections(holdings: DataFrame, orders: DataFrame, collections: DataFrame,
                    viewers: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
    """D1-D3 for every viewer account at once (or for the ``viewers`` frame):

    * owned -- rows the viewer holds;
    * delegated_in -- rows delegated to the viewer;
    * listed -- the viewer's open sell orders joined to the escrowed instance
      (inner join on (symbol, nft_id)), with price, token and fee.

    One flat row per (viewer, section, item). The optional symbol filter
    applies to all three sections (L9).
    """
    extras = [c for c in ITEM_EXTRAS if c in holdings.columns]
    fees = [c for c in ORDER_EXTRAS if c in orders.columns]
    cols = ["symbol", "nft_id", "account", "owned_by", "delegated_to", *extras, "properties"]
    h = holdings.select(*cols)
    # owned and delegated-in rows from a single pass over holdings
    who = F.explode(F.filter(F.array(
        F.struct(F.col("account").alias("viewer"), F.lit("owned").alias("section")),
        F.struct(F.col("delegated_to").alias("viewer"), F.lit("delegated_in").alias("section"))),
        lambda v: v["viewer"].isNotNull()))
    mine = h.select(who.alias("w"), *cols).select(
        "w.viewer", "w.section", *cols, F.lit(None).cast("decimal(38,18)").alias("price"),
        F.lit(None).cast("string").alias("price_symbol"), *[F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in fees])
    o = orders.select("symbol", "nft_id", F.col("account").alias("viewer"), "price", "price_symbol", *fees)
    listed = o.join(h.drop("account"), ["symbol", "nft_id"], "inner").select(
        "viewer", F.lit("listed").alias("section"), "symbol", "nft_id", F.col("viewer").alias("account"),
        "owned_by", "delegated_to", *extras, "properties", F.col("price").cast("decimal(38,18)").alias("price"), "price_symbol", *fees)
    out = mine.unionByName(listed)
    if viewers is not None:
        out = out.join(viewers.select(F.col("account").alias("viewer")).distinct(), "viewer", "left_semi")
    if symbol:
        out = out.where(F.col("symbol") == symbol)
    return out.join(_coll_names(collections), "symbol", "left")


def wallet_pages(items: DataFrame, id_range: int = WALLET_ID_RANGE) -> DataFrame:
    """E9 nested form: items grouped by (viewer, section, symbol) in nft_id
    order, split into fixed nft_id ranges so no group (e.g. the escrow
    account's) is collected whole into one task."""
    item = F.struct(*[F.col(c) for c in items.columns if c not in ("viewer", "section", "symbol")])
    return (items.withColumn("id_range", F.floor(F.col("nft_id") / int(id_range)).cast("bigint"))
            .groupBy("viewer", "section", "symbol", "id_range")
            .agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["nft_id"] < b["nft_id"], -1)
                              .when(a["nft_id"] > b["nft_id"], 1).otherwise(0)).alias("items")))


def wallet_view(holdings: DataFrame, orders: DataFrame, collections: DataFrame, mappings: DataFrame,
                accounts: DataFrame | None = None, symbol: str | None = None, nested: bool = False) -> DataFrame:
    """E9 composite (D1-D3 -> G1 -> E9): wallet rows with their display object
    for all viewers or the ``accounts`` frame; ``nested=True`` groups them into
    bounded id-range pages."""
    from .display import compile_rules, display_object
    items = wallet_sections(holdings, orders, collections, viewers=accounts, symbol=symbol)
    shown = display_object(items, compile_rules(mappings))
    return wallet_pages(shown) if nested else shown


def nft_detail(holdings: DataFrame, collections: DataFrame, orders: DataFrame,
               keys: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """Instance rows with collection name, the open order (if any) as a
    struct and, given the rules, the display object; all instances, or the requested (symbol, nft_id) keys."""
    h = holdings if keys is None else holdings.join(keys.select("symbol", "nft_id"), ["symbol", "nft_id"], "left_semi")
    fees = [c for c in ORDER_EXTRAS if c in orders.columns]
    o = orders.select("symbol", "nft_id", F.struct("price", "price_symbol", *fees, "account", "ts").alias("open_order"))
    # the two fact tables first: stored in equal buckets of the key, they join where they lie
    both = h.join(o, ["symbol", "nft_id"], "left").join(_coll_names(collections), "symbol", "left")
    out = both.select(*h.columns, "collection_name", "open_order")
    if mappings is None:
        return out
    from .display import compile_rules, display_object
    return display_object(out, compile_rules(mappings))


def collection_rows(collections: DataFrame, mappings: DataFrame) -> DataFrame:
    """Collections with burned (B19) and the mapping flag."""
    m = mappings.select("symbol").distinct().withColumn("_m", F.lit(True))
    return (collections.withColumn("burned", burned())
            .join(m, "symbol", "left")
            .withColumn("has_display_mapping", F.coalesce(F.col("_m"), F.lit(False))).drop("_m"))


def collections_page(collections: DataFrame, mappings: DataFrame, cursor: str = "", limit: int = 100) -> DataFrame:
    """symbol > cursor ascending, one page (the next cursor is the last
    symbol of a full page, see ``pages.next_cursor``)."""
    return keyset_page(collection_rows(collections, mappings), "symbol", cursor, limit)


def collection_detail(collections: DataFrame, mappings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Requested symbols (a frame) -> their collection rows."""
    c = collections.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return collection_rows(c, mappings)


def orders_pages(orders: DataFrame, limit: int = 100, cursors: DataFrame | None = None,
                 seller: str | None = None) -> DataFrame:
    """F3 in bulk: a page of every symbol's book (nft_id ascending): the first one, or with
    ``cursors`` (symbol, cursor) the one after each symbol's cursor (of several the greatest), for the symbols that have one.
    ``row_number <= n`` lets Spark insert a partial per-partition group limit
    before the shuffle, so a symbol with a huge book ships at most n rows per
    map task."""
    _, n = page_params(0, limit)
    if seller:
        orders = orders.where(F.col("account") == seller)
    if cursors is not None:
        after = cursors.where(F.col("cursor").isNotNull()).groupBy("symbol").agg(F.max("cursor").alias("_after"))
        orders = orders.join(after, "symbol").where(F.col("nft_id") > F.col("_after")).drop("_after")
    w = Window.partitionBy("symbol").orderBy("nft_id")
    ranked = orders.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    # next cursor on the last row of a full page (no extra window needed)
    return ranked.withColumn("next_cursor", F.when(F.col("_rn") == n, F.col("nft_id"))).drop("_rn")


ACTIVITY_COLS = ["he_block", "tx_seq", "symbol", "nft_id", "op", "account", "counterparty", "price",
                 "price_symbol", "tx_id", "ts"]


def _feed_filter(e: DataFrame, symbol: str | None, op: str | None) -> DataFrame:
    if symbol:
        e = e.where(F.col("symbol") == symbol)
    return e.where(F.col("op") == op) if op else e


def below(block: Column, seq: Column) -> Column:
    """Strictly older than the cursor pair."""
    return (F.col("he_block") < block) | ((F.col("he_block") == block) & (F.col("tx_seq") < seq))


def account_activity(events: DataFrame, account: str, cursor: str | tuple[int, int] | None = None, limit: int = 100,
                     symbol: str | None = None, op: str | None = None) -> DataFrame:
    """one account's feed (as actor or counterparty), newest first, strictly below the cursor, a pair
    (he_block, tx_seq) or its text ``block:seq`` (L13)."""
    _, n = page_params(0, limit)
    e = _feed_filter(events.where((F.col("account") == account) | (F.col("counterparty") == account)), symbol, op)
    if cursor:
        e = e.where(below(*(F.lit(x) for x in parse_activity_cursor(cursor))))
    return e.orderBy(F.col("he_block").desc(), F.col("tx_seq").desc()).limit(n)


def activity_feeds(events: DataFrame, limit: int = 100, cursors: DataFrame | None = None, symbol: str | None = None,
                   op: str | None = None) -> DataFrame:
    """F4 in bulk: a page of every account's feed: the newest one, or with ``cursors`` (viewer, cursor) the one
    below each viewer's cursor (of several the oldest), for the viewers that have one. An event without an
    actor is in its counterparty's feed. The OR
    predicate becomes a union of two equi paths (actor rows, counterparty
    rows) de-duplicated on (viewer, he_block, tx_seq); the per-account top-n
    is a ``row_number <= n`` filter, which Spark evaluates as a partial group
    limit before the shuffle and a final one after it -- a hot account
    costs n rows per map task, not its whole history."""
    _, n = page_params(0, limit)
    rows = feed_rows(_feed_filter(events, symbol, op))
    if cursors is not None:
        part = lambda k: F.split_part("cursor", F.lit(":"), F.lit(k)).cast("bigint")
        older = cursors.where(F.col("cursor").isNotNull()).groupBy("viewer").agg(
            F.min(F.struct(part(1).alias("_b"), part(2).alias("_s"))).alias("_c")).select("viewer", "_c.*")
        rows = rows.join(older, "viewer").where(below(F.col("_b"), F.col("_s"))).drop("_b", "_s")
    w = Window.partitionBy("viewer").orderBy(F.col("he_block").desc(), F.col("tx_seq").desc())
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    # the cursor of a full page's last row is that viewer's next cursor
    return ranked.withColumn("next_cursor", F.when(F.col("rank") == n, activity_cursor("he_block", "tx_seq")))


def feed_rows(events: DataFrame) -> DataFrame:
    """Every event once for each of its viewers: its actor, and its counterparty if that is somebody else."""
    e = events.select(*ACTIVITY_COLS)
    actor = e.where(F.col("account").isNotNull()).withColumn("viewer", F.col("account"))
    cpty = e.where(F.col("counterparty").isNotNull() & ~F.col("counterparty").eqNullSafe(F.col("account"))) \
            .withColumn("viewer", F.col("counterparty"))
    return actor.unionByName(cpty)


def activity_coverage(events: DataFrame, backfill_cursor: int | None = None, backfill_target: int | None = None,
                      window_days: int = 30) -> DataFrame:
    """Oldest captured event, the advisory window, the backfill cursor (from the progress rows, see
    :func:`backfill_cursor`; NULL without a backfill) and target (blocks), and whether the backfill reached it."""
    from .state import backfill_target_col
    agg = events.agg(F.min("ts").alias("oldest_event_ts"), F.max("he_block").alias("_hi"))
    cur = F.lit(backfill_cursor).cast("bigint")
    tgt = F.lit(backfill_target).cast("bigint") if backfill_target is not None else backfill_target_col(F.col("_hi"), window_days)
    return agg.select(F.lit(int(window_days)).alias("window_days"), "oldest_event_ts",
                      cur.alias("backfill_cursor_block"), tgt.alias("backfill_target_block"),
                      F.coalesce(cur <= tgt, F.lit(False)).alias("backfill_complete"))


def distinct_held_symbols(holdings: DataFrame) -> DataFrame:
    """The symbols with cached instances (market sweep scope)."""
    return holdings.select("symbol").distinct()


def capture_freshness(pipeline_state: DataFrame) -> DataFrame:
    """E7 loop freshness from the capture's progress rows; backfill rows are
    excluded (their cursor moves backwards and would look stale)."""
    return (pipeline_state.where(F.col("mode") == "live")
            .agg(F.max("last_block").alias("last_live_block"), F.max("updated_at").alias("updated_at")))


def backfill_cursor(pipeline_state: DataFrame) -> DataFrame:
    """E6 cursor: the lowest block a backfill run has captured (backfill
    walks backwards, so this is how far back the feed reaches)."""
    return pipeline_state.where(F.col("mode") == "backfill").agg(F.min("first_block").alias("backfill_cursor_block"))


def pipeline_status(parts: list[DataFrame]) -> DataFrame:
    """(metric, value) rows. Each part is a one-row aggregate whose
    columns are metrics; it is computed once and unpivoted, and the parts are
    unioned -- no product of frames is formed."""
    out = None
    for df in parts:
        cols = [F.col(f"`{c}`").cast("double").alias(c) for c in df.columns]
        long = df.select(*cols).unpivot([], df.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out
