"""Open-work queries: pending scopes and retries (C7, E4), due accounts (C9), dirty books (C8), held symbols
(C11), refresh plan (C10), block gaps and backfill window (C12), stale reads (C7), the account clock (C6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import parse, state
from ...sources import fixtures as fx
from .common import ORACLE, SALES_AS_OF, fresh_dir, register, with_ctes
from .parsing import ev_sql, fx_blocks


# -- open work: pending scopes, retries, dirty books, due accounts, plan -------

PENDING_AS_OF = "2024-01-20 00:00:00"


def _event_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.fx_events(spark, sf_dir)
    return (e.select("account", "symbol", F.col("ts").alias("touched_at"))
            .unionByName(e.where(F.col("counterparty").isNotNull())
                         .select(F.col("counterparty").alias("account"), "symbol", F.col("ts").alias("touched_at"))))


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked accounts: the account table plus every account with a successful
    fetch (only tracked accounts are ever fetched)."""
    o = fx.fx_scope_outcomes(spark, sf_dir).where("ok").select("account")
    return fx.fx_accounts(spark, sf_dir).select("account").unionByName(o)


def pending_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_scopes(_event_touches(spark, sf_dir), fx.fx_scope_outcomes(spark, sf_dir),
                                _tracked(spark, sf_dir), PENDING_AS_OF)


PENDING_SQL = f"""tr AS (SELECT account FROM fx_accounts UNION SELECT account FROM fx_scope_outcomes WHERE ok),
touch AS (
  SELECT account, symbol, MAX(ts) AS last_touch FROM (
    SELECT account, symbol, ts FROM fx_events
    UNION ALL SELECT counterparty, symbol, ts FROM fx_events WHERE counterparty IS NOT NULL) t
  WHERE ts <= TIMESTAMP '{PENDING_AS_OF}' AND account IN (SELECT account FROM tr)
  GROUP BY account, symbol),
o AS (SELECT * FROM fx_scope_outcomes WHERE fetched_at <= TIMESTAMP '{PENDING_AS_OF}'),
lok AS (SELECT account, symbol, MAX(fetched_at) AS last_ok FROM o WHERE ok GROUP BY account, symbol),
fails AS (
  SELECT o.account, o.symbol, COUNT(*) AS attempts, MAX(o.fetched_at) AS last_fail
  FROM o LEFT JOIN lok ON o.account = lok.account AND o.symbol = lok.symbol
  WHERE NOT o.ok AND (lok.last_ok IS NULL OR o.fetched_at > lok.last_ok)
  GROUP BY o.account, o.symbol),
s AS (
  SELECT COALESCE(t.account, f.account) AS account, COALESCE(t.symbol, f.symbol) AS symbol,
         t.last_touch, f.attempts, f.last_fail
  FROM touch t FULL JOIN fails f ON t.account = f.account AND t.symbol = f.symbol),
pending AS (
  SELECT s.account, s.symbol, greatest(s.last_touch, s.last_fail) AS queued_at,
         CAST(COALESCE(s.attempts, 0) AS BIGINT) AS attempts,
         CASE WHEN COALESCE(s.attempts, 0) > 0
              THEN s.last_fail + to_seconds(least(60 * power(2, s.attempts - 1), 21600))
              ELSE greatest(s.last_touch, s.last_fail) END AS not_before
  FROM s LEFT JOIN lok ON s.account = lok.account AND s.symbol = lok.symbol
  WHERE (s.last_touch IS NOT NULL AND (lok.last_ok IS NULL OR s.last_touch > lok.last_ok))
     OR COALESCE(s.attempts, 0) > 0)"""


@register("pending_scopes", with_ctes(PENDING_SQL, "fx_events", "fx_accounts", "fx_scope_outcomes",
                                  body="SELECT * FROM pending"))
def q_pending_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_frame(spark, sf_dir)


INCREMENTS = 10


@register("pending_scopes_kept", with_ctes(PENDING_SQL, "fx_events", "fx_accounts", "fx_scope_outcomes",
                                           body="SELECT * FROM pending"))
def q_pending_scopes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 from a stored state that ten updates have built. The rows reach it out of order (an update holds rows of all
    times), and the last update runs twice, as after a crash."""
    from ..jobs import scope_state, update_scope_state
    path = fresh_dir(spark, "scope-state")
    t = F.lit(PENDING_AS_OF).cast("timestamp")
    part = lambda ts: F.pmod(F.xxhash64("account", "symbol", ts), F.lit(INCREMENTS))
    touches = _event_touches(spark, sf_dir).where(F.col("touched_at") <= t)
    outcomes = fx.fx_scope_outcomes(spark, sf_dir).where(F.col("fetched_at") <= t)
    for k in [*range(INCREMENTS), INCREMENTS - 1]:
        update_scope_state(spark, path, touches.where(part("touched_at") == k), outcomes.where(part("fetched_at") == k), batch=k, buckets=4)
    return state.pending_from_state(*scope_state(spark, path), _tracked(spark, sf_dir))


@register("retry_stats", with_ctes(PENDING_SQL, "fx_events", "fx_accounts", "fx_scope_outcomes", body="""
SELECT COUNT(*) AS pending, MAX(attempts) AS max_attempts, MIN(not_before) AS next_retry_at
FROM pending WHERE attempts > 0"""))
def q_retry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...operators import views
    return views.retry_stats(pending_frame(spark, sf_dir))


DUE_BATCH = 50


@register("due_accounts", with_ctes(PENDING_SQL, "fx_events", "fx_accounts", "fx_scope_outcomes", body=f"""
SELECT account, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols, MIN(queued_at) AS first_queued
FROM pending WHERE not_before <= TIMESTAMP '{PENDING_AS_OF}'
GROUP BY account ORDER BY first_queued, account LIMIT {DUE_BATCH}"""))
def q_due_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = state.due_accounts(pending_frame(spark, sf_dir), PENDING_AS_OF, DUE_BATCH)
    return d.select("account", F.array_join("syms", ",").alias("symbols"), "first_queued")


@register("dirty_symbols", fx.with_fixtures("""
SELECT f.symbol, f.flagged_at, s.last_snapshot FROM
  (SELECT symbol, MAX(ts) AS flagged_at FROM fx_events WHERE op LIKE 'market\\_%' ESCAPE '\\' GROUP BY symbol) f
  LEFT JOIN (SELECT symbol, MAX(fetched_at) AS last_snapshot FROM fx_book_outcomes WHERE ok GROUP BY symbol) s
  ON f.symbol = s.symbol
WHERE s.last_snapshot IS NULL OR f.flagged_at > s.last_snapshot""", "fx_events", "fx_book_outcomes"))
def q_dirty_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dirty_symbols(fx.fx_events(spark, sf_dir), fx.fx_book_outcomes(spark, sf_dir))


@register("held_symbols", fx.with_fixtures("""
SELECT account, symbol FROM fx_holdings
UNION SELECT delegated_to, symbol FROM fx_holdings WHERE delegated_to IS NOT NULL""", "fx_holdings"))
def q_held_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.held_symbols(fx.fx_holdings(spark, sf_dir))


# refresh plan: buyers of the last 30 days of sales are touched in the bought
# symbol; a buy paid in TOKR (a returned line) also asks for a whole-account check.
PLAN_AS_OF = SALES_AS_OF


def _sale_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.fx_sales(spark, sf_dir)
    return (s.select(F.col("buyer").alias("account"), "symbol", F.col("ts").alias("touched_at"))
            .unionByName(s.where(F.col("price_symbol") == "TOKR")
                         .select(F.col("buyer").alias("account"), F.lit("").alias("symbol"), F.col("ts").alias("touched_at"))))


@register("refresh_plan", fx.with_fixtures(f"""
, p AS (
  SELECT DISTINCT account, symbol FROM (
    SELECT buyer AS account, symbol, ts FROM fx_sales
    UNION ALL SELECT buyer, '', ts FROM fx_sales WHERE price_symbol = 'TOKR') t
  WHERE ts <= TIMESTAMP '{PLAN_AS_OF}' AND ts > TIMESTAMP '{PLAN_AS_OF}' - INTERVAL 30 DAY
    AND account IN (SELECT account FROM fx_accounts)),
held AS (SELECT account, symbol FROM fx_holdings
         UNION SELECT delegated_to, symbol FROM fx_holdings WHERE delegated_to IS NOT NULL),
m AS (
  SELECT d.account,
         CASE WHEN a.populated_at IS NULL THEN 'full'
              WHEN d.whole AND NOT EXISTS (SELECT 1 FROM held h WHERE h.account = d.account) THEN 'full'
              WHEN d.whole THEN 'held' ELSE 'targeted' END AS mode
  FROM (SELECT account, bool_or(symbol = '') AS whole FROM p GROUP BY account) d
  LEFT JOIN fx_accounts a ON a.account = d.account)
SELECT account, mode, CAST(NULL AS VARCHAR) AS symbol FROM m WHERE mode = 'full'
UNION ALL
SELECT DISTINCT * FROM (
  SELECT p.account, m.mode, p.symbol FROM p JOIN m ON p.account = m.account WHERE m.mode <> 'full' AND p.symbol <> ''
  UNION ALL
  SELECT h.account, m.mode, h.symbol FROM held h JOIN m ON h.account = m.account WHERE m.mode = 'held') t""",
                                         "fx_sales", "fx_holdings", "fx_accounts"))
def q_refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "account string, symbol string, ok boolean, fetched_at timestamp")
    recent = _sale_touches(spark, sf_dir).where(
        F.col("touched_at") > F.lit(PLAN_AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    accounts = fx.fx_accounts(spark, sf_dir)
    pending = state.pending_scopes(recent, empty, accounts, PLAN_AS_OF)
    due = state.due_scopes(pending, PLAN_AS_OF)
    return state.refresh_plan(due, fx.fx_holdings(spark, sf_dir), accounts)


@register("block_gaps", ev_sql("""
, have AS (SELECT DISTINCT he_block FROM ev WHERE he_block % 97 <> 5)
SELECT g.generate_series AS he_block
FROM generate_series((SELECT MIN(he_block) FROM have), (SELECT MAX(he_block) FROM have)) g
WHERE g.generate_series NOT IN (SELECT he_block FROM have)"""))
def q_block_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _captured_blocks(spark, sf_dir)
    lo, hi = _block_range(have)
    return state.block_gaps(spark, have, lo, hi)


def _captured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks present in the capture: every block whose number is not 5 mod 97
    (the others were 'missed' by a lagging node)."""
    b = parse.typed_blocks(fx_blocks(spark, sf_dir)).select("he_block")
    return b.where(F.col("he_block") % 97 != 5)


def _block_range(have: DataFrame) -> tuple[int, int]:
    r = have.agg(F.min("he_block").alias("lo"), F.max("he_block").alias("hi")).first()
    return int(r["lo"]), int(r["hi"])


@register("complete_through", ev_sql("""
, have AS (SELECT DISTINCT he_block FROM ev WHERE he_block % 97 <> 5),
gaps AS (SELECT g.generate_series AS he_block
         FROM generate_series((SELECT MIN(he_block) FROM have), (SELECT MAX(he_block) FROM have)) g
         WHERE g.generate_series NOT IN (SELECT he_block FROM have))
SELECT COALESCE(MIN(he_block) - 1, (SELECT MAX(he_block) FROM have)) AS complete_through FROM gaps"""))
def q_complete_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _captured_blocks(spark, sf_dir)
    lo, hi = _block_range(have)
    return state.complete_through(state.block_gaps(spark, have, lo, hi), hi)


@register("block_gaps_kept", ORACLE["block_gaps"])
def q_block_gaps_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12/I4 from captured runs that three updates have kept (blocks in any order, some twice)."""
    from ..jobs import update_block_runs
    path, have = fresh_dir(spark, "block-runs"), _captured_blocks(spark, sf_dir).checkpoint(eager=True)
    for k in range(3):
        update_block_runs(spark, path, have.where(F.col("he_block") % 5 <= 2 * k), bucket_blocks=100)
    lo, hi = _block_range(have)
    return state.gap_blocks(state.gap_runs(spark.read.parquet(path), lo, hi))


@register("backfill_window", ev_sql("""
SELECT MAX(he_block) AS head, greatest(1, MAX(he_block) - 30 * 28800) AS target FROM ev"""))
def q_backfill_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parse.typed_blocks(fx_blocks(spark, sf_dir))
    return b.agg(F.max("he_block").alias("head")).select(
        "head", state.backfill_target_col(F.col("head")).alias("target"))



# -- C7 read side: stale reads ---------------------------------------------------
# Buyers read their wallet when they buy: a read of a populated account more
# than 6 hours after its last full pass queues a whole-account re-check.

@register("stale_read_touches", fx.with_fixtures(f"""
SELECT s.buyer AS account, '' AS symbol, MIN(s.ts) AS touched_at
FROM fx_sales s JOIN fx_accounts a ON a.account = s.buyer
WHERE a.populated_at IS NOT NULL AND s.ts <= TIMESTAMP '{SALES_AS_OF}'
  AND s.ts > a.refreshed_at + INTERVAL 6 HOUR
GROUP BY s.buyer""", "fx_sales", "fx_accounts"))
def q_stale_read_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.fx_sales(spark, sf_dir).where(F.col("ts") <= F.lit(SALES_AS_OF).cast("timestamp"))
    reads = s.select(F.col("buyer").alias("account"), F.col("ts").alias("read_at"))
    return state.stale_read_touches(reads, fx.fx_accounts(spark, sf_dir))



# -- C6 clock: full passes --------------------------------------------------------
# Full passes (scope '') over the accounts: every customer whose orders include a
# finished one gets a full pass one day after its last order; the pass fails
# for customers whose key ends in 7.

@register("apply_account_passes", fx.with_fixtures("""
, passes AS (
  SELECT 'acct' || CAST(o_custkey AS VARCHAR) AS account, MAX(o_orderdate) + INTERVAL 1 DAY AS fetched_at,
         o_custkey % 10 <> 7 AS ok
  FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F')),
okp AS (SELECT account, fetched_at FROM passes WHERE ok)
SELECT COALESCE(a.account, p.account) AS account, COALESCE(a.first_seen_at, p.fetched_at) AS first_seen_at,
       greatest(a.refreshed_at, p.fetched_at) AS refreshed_at, COALESCE(a.populated_at, p.fetched_at) AS populated_at
FROM fx_accounts a FULL JOIN okp p ON a.account = p.account""", "fx_accounts"))
def q_apply_account_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    passes = (o.groupBy("o_custkey")
              .agg(F.max("o_orderdate").alias("last"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("fin"))
              .where(F.col("fin") == 1)
              .select(F.concat(F.lit("acct"), F.col("o_custkey").cast("string")).alias("account"), F.lit("").alias("symbol"),
                      (F.col("o_custkey") % 10 != 7).alias("ok"),
                      (F.col("last").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("fetched_at")))
    # targeted passes never move the clock: add one per account, newer than any full pass
    targeted = passes.select("account", F.lit("SYM0").alias("symbol"), F.lit(True).alias("ok"),
                             (F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")).alias("fetched_at"))
    return state.apply_account_passes(fx.fx_accounts(spark, sf_dir).select("account", "first_seen_at", "refreshed_at",
                                                                           "populated_at"),
                                      passes.unionByName(targeted))
