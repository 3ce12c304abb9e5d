"""Applying current-state snapshots and deriving open work.

State is never folded from events: holdings, the catalog and order books come
only from snapshots, and a scope whose fetch failed (or was cut short) keeps
its previous rows. With no MERGE on plain parquet tables, every application
produces a new frame: ``old minus replaced scopes`` plus ``new rows``, de-
duplicated on the row key.

Scale notes: the scope filters are joins against the (small) frame of
confirmed scopes, so AQE turns them into broadcast joins at runtime when that
frame is small and shuffle joins otherwise. The new rows are reduced to one a
key, then one full join by row key merges them with the kept rows.
Aggregations are hash aggregates with map-side partial results, so a hot
account or symbol costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .market import as_ts

# Retry back-off, staleness bound, backfill window.
RETRY_BASE_SECONDS = 60
RETRY_CAP_SECONDS = 21600
ACCOUNT_STALE_AFTER_SECONDS = 21600
ACTIVITY_WINDOW_DAYS = 30
BLOCKS_PER_DAY = 28800
SETTLE_BLOCKS = 1


def confirmed(outcomes: DataFrame) -> Column:
    """The one rule for a fetch that says what a scope holds (C2, C4, C6, C7, C8): it succeeded and was complete
    (L1/L2: a failed or cut-short fetch confirms nothing and closes nothing)."""
    complete = F.coalesce(F.col("complete"), F.lit(True)) if "complete" in outcomes.columns else F.lit(True)
    return F.coalesce(F.col("ok"), F.lit(False)) & complete


def confirmed_scopes(outcomes: DataFrame, keys: list[str], applied: DataFrame | None = None) -> DataFrame:
    """Scopes with a confirmed fetch, and the time of the latest one; a later failure takes nothing back. With
    ``applied`` (keys, fetched_at: what has been applied before) scopes whose fetch is older than that are left
    out: a fetch that arrives late changes nothing."""
    found = outcomes.where(confirmed(outcomes)).groupBy(*keys).agg(F.max("fetched_at").alias("fetched_at"))
    if applied is None:
        return found
    last = applied.groupBy(*keys).agg(F.max("fetched_at").alias("_last"))
    return found.join(last, keys, "left").where(F.col("_last").isNull() | (F.col("fetched_at") >= F.col("_last"))).drop("_last")


def _of_confirmed_fetch(records: DataFrame, conf: DataFrame, keys: list[str]) -> DataFrame:
    """The records of each scope's confirmed fetch, with its time as ``_f``. Records that carry their own
    ``fetched_at`` count only if it is that time, so two fetches of a scope are never mixed."""
    rows = records.join(conf.withColumnRenamed("fetched_at", "_f"), keys, "inner")
    return rows.where(F.col("fetched_at") == F.col("_f")).drop("fetched_at") if "fetched_at" in records.columns else rows


def replace_scopes(cur: DataFrame, new: DataFrame, confirmed: DataFrame, scope_keys: list[str],
                   row_keys: list[str], order: Column, row_time: str | None = None) -> DataFrame:
    """Shared core of C1, C2/C3 and C4.

    Rows of ``cur`` (one a row key) in a confirmed scope are removed; rows of ``new`` in a
    confirmed scope are added; of the rows with one row key the one with the highest ``order`` wins
    (``order`` is evaluated on both sides). With ``row_time`` (a column of ``cur``), rows that are newer than
    the scope's fetch (``fetched_at`` of ``confirmed``, one row a scope) stay: an old fetch knows nothing of them.
    ``new`` is reduced to one row a key first, then one full join by row key decides: each side is read once.
    """
    scopes = confirmed.select(*scope_keys).distinct()
    rest = F.struct(*[F.col(c) for c in cur.columns if c not in row_keys])
    if row_time is None:
        stays = cur.join(scopes, scope_keys, "left_anti")
    else:
        stays = cur.join(confirmed.select(*scope_keys, F.col("fetched_at").alias("_fetched"), F.lit(True).alias("_hit")), scope_keys, "left")
        stays = stays.where(F.col("_hit").isNull() | F.coalesce(F.col(row_time) > F.col("_fetched"), F.lit(False)))
    kept = stays.select(*row_keys, order.alias("_old_order"), rest.alias("_old"))
    fresh = (new.join(scopes, scope_keys, "left_semi").select(*row_keys, order.alias("_order"), rest.alias("_row"))
             .groupBy(*row_keys).agg(F.max("_order").alias("_new_order"), F.max_by("_row", "_order").alias("_new")))
    newer = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_new_order") >= F.col("_old_order")))
    both = kept.join(fresh, row_keys, "full")
    return both.select(*row_keys, F.when(newer, F.col("_new")).otherwise(F.col("_old")).alias("_w")).select(
        *row_keys, "_w.*").select(*cur.columns)


# -- C1 ------------------------------------------------------------------------

def upsert_catalog(cur: DataFrame, snap: DataFrame) -> DataFrame:
    """Insert or overwrite by symbol; symbols missing from the snapshot
    stay. Within one snapshot the later record (``pos``) wins."""
    new = snap if "pos" in snap.columns else snap.withColumn("pos", F.lit(0))
    conf = new.select("symbol").distinct()
    # records without a position tie: any fixed order of their content will do
    plain = (T.StringType, T.NumericType, T.BooleanType, T.TimestampType)
    rest = [f.name for f in cur.schema.fields if f.name != "symbol" and isinstance(f.dataType, plain)]
    order = F.struct(F.col("_src"), F.col("_pos"), *[F.col(k) for k in rest])
    c = cur.withColumn("_src", F.lit(0)).withColumn("_pos", F.lit(0).cast("bigint"))
    n = new.withColumn("_src", F.lit(1)).withColumn("_pos", F.col("pos").cast("bigint")).drop("pos")
    out = replace_scopes(c, n.select(*c.columns), conf, ["symbol"], ["symbol"], order)
    return out.drop("_src", "_pos")


# -- C2 / C3 ---------------------------------------------------------------------

def apply_holdings(cur: DataFrame, fetched: DataFrame, outcomes: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """C2 + C3: for each confirmed (account, symbol) replace that account's
    rows in that symbol with the fetched ones; failed scopes are untouched.
    An instance fetched for a new owner replaces a stale row of its old
    owner when the fetch is newer (ties: the fetched row wins), L16. A fetch that arrives late removes no row
    refreshed after it, and with ``applied`` (account, symbol, fetched_at) brings nothing back either."""
    conf = confirmed_scopes(outcomes, ["account", "symbol"], applied)
    new = (_of_confirmed_fetch(fetched, conf, ["account", "symbol"])
           .withColumn("refreshed_at", F.coalesce(F.col("refreshed_at"), F.col("_f")) if "refreshed_at" in fetched.columns else F.col("_f"))
           .drop("_f"))
    c = cur.withColumn("_src", F.lit(0))
    n = new.withColumn("_src", F.lit(1)).select(*c.columns)
    # newest fetch wins; then fetched over cached; then the account name, so
    # two same-time claims on one instance resolve the same way on every run
    order = F.struct(F.col("refreshed_at"), F.col("_src"), F.col("account"))
    return replace_scopes(c, n, conf, ["account", "symbol"], ["symbol", "nft_id"], order, "refreshed_at").drop("_src")


# -- C4 ------------------------------------------------------------------------

def apply_book(cur: DataFrame, orders: DataFrame, outcomes: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """C4: replace a symbol's whole book when its snapshot is confirmed
    (complete); on a duplicate nft_id the first record (lowest ``pos``)
    wins. A failed or cut-short snapshot keeps the old book (L1), and with ``applied`` (symbol, fetched_at: the
    snapshot that each book holds) so does one that is older than the book's."""
    conf = confirmed_scopes(outcomes, ["symbol"], applied)
    new = _of_confirmed_fetch(orders if "pos" in orders.columns else orders.withColumn("pos", F.lit(0)), conf, ["symbol"])
    c = cur.withColumn("_pos", F.lit(None).cast("bigint"))
    n = new.withColumn("_pos", F.col("pos").cast("bigint")).select(*c.columns)
    # records without a position tie: any fixed order of their content will do
    rest = [k for k in cur.columns if k not in ("symbol", "nft_id")]
    order = F.struct(-F.coalesce(F.col("_pos"), F.lit(0)), *[F.col(k) for k in rest])
    return replace_scopes(c, n, conf, ["symbol"], ["symbol", "nft_id"], order).drop("_pos")


# -- B16 / B17 / B18 ---------------------------------------------------------------

def known_symbols(collections: DataFrame, holdings: DataFrame) -> DataFrame:
    """Symbols worth checking: circulating supply unknown or positive,
    or still held in the cache (so stale rows can be refreshed away)."""
    held = holdings.select("symbol").distinct().withColumn("_held", F.lit(True))
    c = collections.select("symbol", "circulating_supply").join(held, "symbol", "left")
    return (c.where(F.col("circulating_supply").isNull() | (F.col("circulating_supply") > 0)
                    | F.col("_held").isNotNull())
            .select("symbol"))


def retain(events: DataFrame, as_of, days: int = ACTIVITY_WINDOW_DAYS) -> DataFrame:
    """Drop rows older than the window (a row exactly at the bound stays).
    When the sink is partitioned by date, this prunes whole partitions."""
    return events.where(F.col("ts") >= as_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def settled_blocks(blocks: DataFrame, head: int, margin: int = SETTLE_BLOCKS, col: str = "he_block") -> DataFrame:
    """Only blocks at least ``margin`` behind the reported head."""
    return blocks.where(F.col(col) <= F.lit(int(head) - int(margin)))


# -- C6 ------------------------------------------------------------------------

def account_state(accounts: DataFrame, as_of, requested: DataFrame | None = None,
                  stale_after_s: int = ACCOUNT_STALE_AFTER_SECONDS, escrow: str | None = None) -> DataFrame:
    """Absent / tracked / populated per account, and stale when the last
    full pass is older than the bound. ``requested`` (a frame of account
    names) adds rows for accounts never seen (state 'absent'). The escrow
    account is always tracked."""
    t = as_ts(as_of)
    a = accounts.select("account", "refreshed_at", "populated_at", F.lit(True).alias("_present"))
    if requested is not None:
        a = requested.select("account").distinct().join(a, "account", "left")
    present = F.coalesce(F.col("_present"), F.lit(False))
    if escrow is not None:
        present = present | (F.col("account") == escrow)
    state = (F.when(~F.coalesce(present, F.lit(False)), F.lit("absent"))
             .when(F.col("populated_at").isNull(), F.lit("tracked"))
             .otherwise(F.lit("populated")))
    stale = F.coalesce(F.col("refreshed_at") < t - F.make_interval(secs=F.lit(stale_after_s)), F.lit(False))
    return a.select("account", state.alias("state"), (stale & (state == "populated")).alias("stale"))


def apply_account_passes(accounts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """C6 clock: only a successful, complete *full* pass (scope symbol '')
    moves an account's ``refreshed_at``, and the first one sets
    ``populated_at``; targeted passes never do. Accounts first seen in a full
    pass are added as tracked."""
    passes = (outcomes.where((F.col("symbol") == "") & confirmed(outcomes)).groupBy("account")
              .agg(F.min("fetched_at").alias("_first"), F.max("fetched_at").alias("_last")))
    j = accounts.join(passes, "account", "full")
    return j.select(
        "account",
        F.coalesce(F.col("first_seen_at"), F.col("_first")).alias("first_seen_at"),
        F.greatest(F.col("refreshed_at"), F.col("_last")).alias("refreshed_at"),
        F.coalesce(F.col("populated_at"), F.col("_first")).alias("populated_at"))


# -- C7 ------------------------------------------------------------------------

def stale_read_touches(reads: DataFrame, accounts: DataFrame,
                       stale_after_s: int = ACCOUNT_STALE_AFTER_SECONDS) -> DataFrame:
    """C7 (read side): a populated account read more than ``stale_after_s``
    after its last full pass asks for a whole-account re-check, scope
    (account, ''). The entry is insert-if-absent, so the first such read
    sets the queue time. Result rows have the shape of touches."""
    a = accounts.where(F.col("populated_at").isNotNull()).select("account", "refreshed_at")
    stale = (reads.join(a, "account", "inner")
             .where(F.col("read_at") > F.col("refreshed_at") + F.make_interval(secs=F.lit(stale_after_s))))
    return (stale.groupBy("account").agg(F.min("read_at").alias("touched_at"))
            .select("account", F.lit("").alias("symbol"), "touched_at"))


def pending_scopes(touches: DataFrame, outcomes: DataFrame, tracked: DataFrame, as_of,
                   base_s: int = RETRY_BASE_SECONDS, cap_s: int = RETRY_CAP_SECONDS) -> DataFrame:
    """Open work per (account, symbol) at ``as_of``.

    A scope is pending when it was touched after its last confirmed fetch
    (or never fetched), or when fetches failed or were cut short since. Touches
    of untracked accounts are ignored (D6). ``attempts`` counts failures
    since the last success (L5); ``not_before`` = last failure +
    least(base * 2^(attempts-1), cap) seconds, else the queue time.
    """
    t = as_ts(as_of)
    tr = _tracked(tracked)
    touch = (touches.where(F.col("touched_at") <= t).join(tr, "account", "left_semi")
             .groupBy("account", "symbol").agg(F.max("touched_at").alias("last_touch")))
    o = outcomes.where(F.col("fetched_at") <= t)
    last_ok = o.where(confirmed(o)).groupBy("account", "symbol").agg(F.max("fetched_at").alias("last_ok"))
    fails = (o.where(~confirmed(o)).join(last_ok, ["account", "symbol"], "left")
             .where(F.col("last_ok").isNull() | (F.col("fetched_at") > F.col("last_ok")))
             .groupBy("account", "symbol")
             .agg(F.count(F.lit(1)).alias("attempts"), F.max("fetched_at").alias("last_fail")))
    s = (touch.join(fails, ["account", "symbol"], "full").join(last_ok, ["account", "symbol"], "left"))
    return _open_work(s, base_s, cap_s)


def _tracked(accounts: DataFrame) -> DataFrame:
    return accounts.select("account").distinct()


def _open_work(s: DataFrame, base_s: int, cap_s: int) -> DataFrame:
    """The pending ones of (account, symbol, last_touch, last_ok, attempts, last_fail), with queue and retry times."""
    touched_since = F.col("last_touch").isNotNull() & (F.col("last_ok").isNull() | (F.col("last_touch") > F.col("last_ok")))
    attempts = F.coalesce(F.col("attempts"), F.lit(0)).cast("bigint")
    backoff = F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), (attempts - 1).cast("double")), F.lit(float(cap_s)))
    queued = F.greatest(F.col("last_touch"), F.col("last_fail"))
    return (s.where(touched_since | (attempts > 0))
            .select("account", "symbol", queued.alias("queued_at"), attempts.alias("attempts"),
                    F.when(attempts > 0, F.col("last_fail") + F.make_interval(secs=backoff))
                     .otherwise(queued).alias("not_before")))


# -- C7, kept up to date --------------------------------------------------------
# Instead of both logs, one row a scope that either names and the failures since the scope's last confirmed fetch.
SCOPE_KEYS = ["account", "symbol"]
SCOPE_DDL = "account string, symbol string, last_touch timestamp, last_ok timestamp"
FAILURE_DDL = "account string, symbol string, fetched_at timestamp, batch bigint"


def fold_scopes(scopes: DataFrame, failures: DataFrame, touches: DataFrame, outcomes: DataFrame,
                batch: int) -> tuple[DataFrame, DataFrame]:
    """C7 step: the state (``SCOPE_DDL``, ``FAILURE_DDL``) with new rows of both logs folded in.

    Exact in whatever order the rows arrive: times are maxima, and failures are kept one by one until a confirmed
    fetch is newer than they are, so an outcome that comes late still counts or cancels the right ones. Folding the same
    batch again changes nothing (its failures are replaced). Needs a checkpoint folder (``session.configure``)."""
    none = F.lit(None).cast("timestamp")
    ok = confirmed(outcomes)
    rows = scopes.select(*SCOPE_KEYS, "last_touch", "last_ok").unionByName(
        touches.select(*SCOPE_KEYS, F.col("touched_at").alias("last_touch"), none.alias("last_ok"))).unionByName(
        outcomes.select(*SCOPE_KEYS, none.alias("last_touch"), F.when(ok, F.col("fetched_at")).alias("last_ok")))
    folded = rows.groupBy(*SCOPE_KEYS).agg(F.max("last_touch").alias("last_touch"), F.max("last_ok").alias("last_ok"))
    folded = folded.checkpoint(eager=True)      # both results come from one pass over the scopes
    open_ = failures.where(F.col("batch") != int(batch)).unionByName(
        outcomes.where(~ok).select(*SCOPE_KEYS, "fetched_at", F.lit(int(batch)).cast("bigint").alias("batch")))
    still = open_.join(folded.select(*SCOPE_KEYS, "last_ok"), SCOPE_KEYS, "left")
    still = still.where(F.col("last_ok").isNull() | (F.col("fetched_at") > F.col("last_ok"))).drop("last_ok")
    return folded, still


def pending_from_state(scopes: DataFrame, failures: DataFrame, tracked: DataFrame,
                       base_s: int = RETRY_BASE_SECONDS, cap_s: int = RETRY_CAP_SECONDS) -> DataFrame:
    """C7 from the state: equal to :func:`pending_scopes` over all rows folded so far, without reading them. An account
    that is tracked later finds its earlier touches here (D6 is applied on reading)."""
    known = _tracked(tracked).withColumn("_tracked", F.lit(True))
    fails = failures.groupBy(*SCOPE_KEYS).agg(F.count(F.lit(1)).alias("attempts"), F.max("fetched_at").alias("last_fail"))
    s = scopes.join(known, "account", "left").withColumn("last_touch", F.when(F.col("_tracked"), F.col("last_touch")))
    return _open_work(s.drop("_tracked").join(fails, SCOPE_KEYS, "left"), base_s, cap_s)


# -- C8 ------------------------------------------------------------------------

def dirty_symbols(events: DataFrame, book_outcomes: DataFrame) -> DataFrame:
    """Symbols whose latest live market_* event is newer than their last
    confirmed book snapshot; an event arriving during a refresh (after the
    snapshot started) keeps the symbol dirty. ``events`` is either activity
    rows (op, ts) or the capture's live-only flag sink (flagged_at), which
    leaves backfilled history out (C13)."""
    if "flagged_at" in events.columns:
        flagged = events.groupBy("symbol").agg(F.max("flagged_at").alias("flagged_at"))
    else:
        flagged = (events.where(F.col("op").startswith("market_") & F.col("symbol").isNotNull())
                   .groupBy("symbol").agg(F.max("ts").alias("flagged_at")))
    snap = book_outcomes.where(confirmed(book_outcomes)).groupBy("symbol").agg(F.max("fetched_at").alias("last_snapshot"))
    j = flagged.join(snap, "symbol", "left")
    return j.where(F.col("last_snapshot").isNull() | (F.col("flagged_at") > F.col("last_snapshot")))


# -- C9 / C10 / C11 ------------------------------------------------------------

def due_accounts(pending: DataFrame, as_of, n: int) -> DataFrame:
    """Due scopes (not_before <= as_of) collapsed per account, oldest
    first, the top ``n`` accounts (the batch size is the feature). The
    symbol set per account is bounded by the catalog size."""
    t = as_ts(as_of)
    return (pending.where(F.col("not_before") <= t)
            .groupBy("account")
            .agg(F.array_sort(F.collect_set("symbol")).alias("syms"), F.min("queued_at").alias("first_queued"))
            .orderBy("first_queued", "account").limit(int(n)))


def due_scopes(pending: DataFrame, as_of) -> DataFrame:
    """Due scopes collapsed per account (C9 without the batch limit)."""
    t = as_ts(as_of)
    return (pending.where(F.col("not_before") <= t).groupBy("account")
            .agg(F.array_sort(F.collect_set("symbol")).alias("syms"), F.min("queued_at").alias("first_queued")))


def held_symbols(holdings: DataFrame) -> DataFrame:
    """(account, symbol) an account owns or has delegated in."""
    own = holdings.select("account", "symbol")
    deleg = holdings.where(F.col("delegated_to").isNotNull()).select(F.col("delegated_to").alias("account"), "symbol")
    return own.union(deleg).distinct()


def refresh_plan(due: DataFrame, holdings: DataFrame, accounts: DataFrame) -> DataFrame:
    """What to re-check per due account.

    * not populated (or unknown) -> mode 'full', symbol NULL = every known
      symbol (the consumer expands it against ``known_symbols``; no account
      x symbol product is built here);
    * '' among the queued symbols -> mode 'held': held symbols plus the named
      ones (L3), or 'full' when the account holds nothing;
    * otherwise mode 'targeted': exactly the named symbols.
    """
    d = due.select("account", "syms").join(accounts.select("account", "populated_at"), "account", "left")
    held = held_symbols(holdings).join(d.select("account"), "account", "left_semi")
    n_held = held.groupBy("account").agg(F.count(F.lit(1)).alias("_n_held"))
    d = d.join(n_held, "account", "left")
    populated = F.col("populated_at").isNotNull()
    whole = F.array_contains("syms", "")
    mode = (F.when(~populated, F.lit("full"))
            .when(whole & F.col("_n_held").isNull(), F.lit("full"))
            .when(whole, F.lit("held")).otherwise(F.lit("targeted")))
    d = d.withColumn("mode", mode)
    full = d.where(F.col("mode") == "full").select("account", "mode", F.lit(None).cast("string").alias("symbol"))
    named = (d.where(F.col("mode") != "full")
             .select("account", "mode", F.explode("syms").alias("symbol")).where(F.col("symbol") != ""))
    held_rows = (held.join(d.where(F.col("mode") == "held").select("account", "mode"), "account")
                 .select("account", "mode", "symbol"))
    return full.unionByName(named.unionByName(held_rows).distinct())


# -- C12 -----------------------------------------------------------------------

def backfill_target(head: int, days: int = ACTIVITY_WINDOW_DAYS, per_day: int = BLOCKS_PER_DAY) -> int:
    """Oldest block of the backfill window."""
    return max(1, int(head) - int(days) * int(per_day))


def backfill_target_col(head: Column, days: int = ACTIVITY_WINDOW_DAYS, per_day: int = BLOCKS_PER_DAY) -> Column:
    """C12 as a column expression over a head block column."""
    return F.greatest(F.lit(1).cast("bigint"), head - int(days) * int(per_day))


def block_gaps(spark, blocks: DataFrame, lo: int, hi: int, col: str = "he_block") -> DataFrame:
    """Block numbers in [lo, hi] that were never captured -- a
    distributed range anti-joined with the captured numbers."""
    want = spark.range(int(lo), int(hi) + 1).withColumnRenamed("id", col)
    have = blocks.select(col).where(F.col(col).between(int(lo), int(hi))).distinct()
    return want.join(have, col, "left_anti")


# -- C12, kept as intervals ------------------------------------------------------


def block_runs(blocks: DataFrame, bucket_blocks: int = BLOCKS_PER_DAY, col: str = "he_block") -> DataFrame:
    """Captured numbers as maximal runs within a bucket of ``bucket_blocks`` numbers: (bucket, lo, hi). Islands are
    found bucket by bucket, so no window holds more than one bucket's rows, and a captured day is one row."""
    bucket = F.floor(F.col("lo") / int(bucket_blocks)).cast("bigint").alias("bucket")
    new = blocks.where(F.col(col).isNotNull()).select(F.col(col).alias("lo"), F.col(col).alias("hi")).distinct().select(bucket, "lo", "hi")
    return merge_runs(new)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Overlapping or adjacent (lo, hi) of a bucket merged."""
    order = Window.partitionBy("bucket").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (starts.withColumn("_island", island).groupBy("bucket", "_island")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island"))


def gap_runs(runs: DataFrame, lo: int, hi: int) -> DataFrame:
    """The missing numbers of [lo, hi] as intervals (lo, hi). One window over the runs: buckets plus gaps, not
    blocks."""
    lo, hi = int(lo), int(hi)
    inside = runs.where((F.col("hi") >= lo) & (F.col("lo") <= hi)).select("lo", "hi")
    ends = runs.sparkSession.createDataFrame([(lo - 1, lo - 1), (hi + 1, hi + 1)], "lo bigint, hi bigint")
    order = Window.orderBy("lo", "hi")
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = inside.unionByName(ends).withColumn("_seen", seen)
    return step.where(F.col("lo") > F.col("_seen") + 1).select((F.col("_seen") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))


def gap_blocks(gaps: DataFrame, col: str = "he_block") -> DataFrame:
    """The numbers of gap intervals, one a row."""
    return gaps.select(F.explode(F.sequence("lo", "hi")).alias(col))


def complete_through(gaps: DataFrame, hi: int, col: str = "he_block") -> DataFrame:
    """Downstream 'complete up to' = last block before the first gap."""
    return gaps.agg(F.coalesce(F.min(col) - 1, F.lit(int(hi))).alias("complete_through"))
