"""Sink and streaming queries: capture stream (A1, I1-I5), idempotent append (A6), per-symbol overwrite
(A7), JSON view (A8), capture-only backfill (C13, I7), backfill runner and retention (I6, I7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import market, state
from ...sources import fixtures as fx
from .common import ORACLE, comparable, fresh_dir, register
from .parsing import ev_sql, fx_blocks, fx_parsed
from .snapshots import book_fixture


# -- sinks and streaming (A1, A6-A8, I1-I7, C13) ----------------------------------

@register("stream_capture", ev_sql("""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, bts AS ts FROM ev WHERE he_block < (SELECT MAX(he_block) FROM ev)"""))
def q_stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the block documents as JSON lines (even blocks in one half of the files, odd ones in
    the other, so later batches also bring blocks older than an earlier one's head), drain them with the
    streaming capture (half of the files in a micro-batch, settle margin 1), read the activity sink
    back. The newest block stays held back by the margin."""
    from ...streaming import capture
    root = fresh_dir(spark, "stream-capture")
    landing = f"{root}/landing"
    docs = fx.fx_block_docs(spark, sf_dir)
    docs.select("value", (F.col("he_block") % 2).alias("odd")).write.partitionBy("odd").text(landing)
    files = spark.read.text(landing).select(F.col("_metadata.file_path")).distinct().count()
    q = capture.start_capture(spark, f"{landing}/*", f"{root}/sinks", checkpoint=f"{root}/checkpoint",
                              max_files_per_trigger=-(-files // 2))
    q.awaitTermination()
    ev = spark.read.parquet(f"{root}/sinks/nft_events").drop("bucket")
    return comparable(ev)


@register("append_idempotent", fx.with_fixtures("""
SELECT symbol, nft_id, CAST(price AS DOUBLE) AS price, price_symbol, seller, buyer, he_block, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, nft_id, he_block ORDER BY ts, price, seller, buyer) AS rn
  FROM fx_sales) t WHERE rn = 1""", "fx_sales"))
def q_append_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the even blocks, then replay everything: each key once."""
    from ...sources.sinks import append_idempotent
    path = fresh_dir(spark, "append-sales")
    s = fx.fx_sales(spark, sf_dir)
    key, order = ["symbol", "nft_id", "he_block"], ["ts", "price", "seller", "buyer"]
    append_idempotent(spark, s.where(F.col("he_block") % 2 == 0), path, key, order, range_col="he_block")
    append_idempotent(spark, s, path, key, order, range_col="he_block")
    return comparable(spark.read.parquet(path))


@register("write_view", ORACLE["apply_book"])
def q_write_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old book written per symbol, then only the replaced symbols
    overwritten (dynamic partition overwrite); read back."""
    from ...sources.sinks import write_view
    path = fresh_dir(spark, "orders-view")
    cur = fx.fx_orders(spark, sf_dir)
    write_view(cur, path, ["symbol"])
    orders, outcomes = book_fixture(spark, sf_dir)
    new_book = state.apply_book(cur, orders, outcomes)
    replaced = state.confirmed_scopes(outcomes, ["symbol"]).select("symbol")
    write_view(new_book.join(replaced, "symbol", "left_semi").select(*cur.columns), path, ["symbol"])
    return comparable(spark.read.parquet(path).select(*cur.columns))


@register("to_json_view", fx.with_fixtures("""
SELECT symbol, price_symbol, grouping_key,
       regexp_replace(regexp_replace(CAST(MIN(price) AS VARCHAR), '0+$', ''), '\\.$', '') AS floor_price_text,
       CAST(COUNT(*) AS VARCHAR) AS open_orders_text
FROM fx_orders GROUP BY symbol, price_symbol, grouping_key""", "fx_orders"))
def q_to_json_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...sources.sinks import to_json_view
    orders = fx.fx_orders(spark, sf_dir).withColumnRenamed("grouping_key", "grouping")
    j = to_json_view(market.market_floor(orders)).select("json")
    g = lambda k: F.get_json_object("json", f"$.{k}")
    return j.select(g("symbol").alias("symbol"), g("price_symbol").alias("price_symbol"),
                    g("grouping_key").alias("grouping_key"), g("floor_price").alias("floor_price_text"),
                    g("open_orders").alias("open_orders_text"))


@register("capture_only", ev_sql("""
SELECT 'nft_events' AS sink, COUNT(*) AS n FROM ev
UNION ALL SELECT 'market_sales', COUNT(*) FROM ev WHERE op = 'market_buy'
UNION ALL SELECT 'touch_scopes', 0
UNION ALL SELECT 'market_flags', 0"""))
def q_capture_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill run records activity and sales but queues nothing."""
    from ...sources.sinks import read_if_exists
    from ...streaming import capture
    root = fresh_dir(spark, "backfill")
    capture.backfill(spark, fx_blocks(spark, sf_dir), root)
    parts = []
    for name in ("nft_events", "market_sales", "touch_scopes", "market_flags"):
        df = read_if_exists(spark, f"{root}/{name}")
        cnt = df.agg(F.count(F.lit(1)).alias("n")) if df is not None else spark.range(1).select(F.lit(0).cast("bigint").alias("n"))
        parts.append(cnt.select(F.lit(name).alias("sink"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out



# -- I6 / I7 over landed block files ------------------------------------------------

def _landed_blocks(spark: SparkSession, sf_dir: str, name: str) -> str:
    root = fresh_dir(spark, name)
    fx.fx_block_docs(spark, sf_dir).select("value").write.text(f"{root}/landing")
    return root


@register("run_backfill", ev_sql("""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, bts AS ts FROM ev"""))
def q_run_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward backfill over the landed blocks in four chunks, from the
    newest block down to the oldest; the activity sink ends up complete."""
    from ...streaming import capture
    root = _landed_blocks(spark, sf_dir, "backfill-run")
    lo, hi = capture.read_blocks(spark, f"{root}/landing").agg(F.min("blockNumber"), F.max("blockNumber")).first()
    chunk = max(1, -(-(hi - lo + 1) // 4))
    capture.run_backfill(spark, f"{root}/landing", f"{root}/sink", target=lo, chunk_blocks=chunk, start_below=hi + 1)
    return comparable(spark.read.parquet(f"{root}/sink/nft_events").drop("bucket"))


RETAIN_SINK_AS_OF = "2024-02-15 00:00:00"


@register("retain_sink", ev_sql(f"""
SELECT he_block, tx_seq, ts FROM (SELECT he_block, tx_seq, bts AS ts FROM ev) e
WHERE ts >= TIMESTAMP '{RETAIN_SINK_AS_OF}' - INTERVAL 30 DAY"""))
def q_retain_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured activity sink after the retention job (whole buckets older than the 30-day window are
    dropped), read with the exact window."""
    from ...streaming import capture
    root = fresh_dir(spark, "retention")
    capture.backfill(spark, fx_blocks(spark, sf_dir), root, bucket_blocks=50)
    capture.retain_sink(spark, f"{root}/nft_events", RETAIN_SINK_AS_OF, days=30)
    return state.retain(spark.read.parquet(f"{root}/nft_events"), RETAIN_SINK_AS_OF).select("he_block", "tx_seq", "ts")


# -- documents that are no block, and blocks that come again --------------------------

def _with_bad_documents(docs: DataFrame) -> DataFrame:
    """The block documents, with some between them that are cut short, without a number or of another shape."""
    n, text = F.col("he_block"), F.col("he_block").cast("string")
    bad = (F.when(n % 20 == 7, F.concat(F.lit('{"blockNumber":'), text, F.lit(",")))
           .when(n % 20 == 3, F.concat(F.lit('{"tag":'), text, F.lit(',"transactions":[]}')))
           .when(n % 20 == 11, F.concat(F.lit("["), text, F.lit("]"))))
    return docs.select(F.explode(F.array_compact(F.array("value", bad))).alias("value"))


@register("block_quarantine", ev_sql("""
SELECT raw, reason FROM (
  SELECT DISTINCT '{"blockNumber":' || CAST(he_block AS VARCHAR) || ',' AS raw, 'not a JSON object' AS reason
  FROM ev WHERE he_block % 20 = 7
  UNION ALL SELECT DISTINCT '{"tag":' || CAST(he_block AS VARCHAR) || ',"transactions":[]}', 'no block number'
  FROM ev WHERE he_block % 20 = 3
  UNION ALL SELECT DISTINCT '[' || CAST(he_block AS VARCHAR) || ']', 'not a JSON object' FROM ev WHERE he_block % 20 = 11) q"""))
def q_block_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut short, without a number or of another shape land between good ones and are captured in two
    batches, the second of which brings everything again: each is kept once, with its reason."""
    from ...streaming import capture
    root = fresh_dir(spark, "quarantine")
    docs = fx.fx_block_docs(spark, sf_dir)
    _with_bad_documents(docs).write.text(f"{root}/landing")
    body = capture.BlockCapture(f"{root}/sinks")
    landed = capture.landed_lines(spark, f"{root}/landing")
    for epoch in (0, 1):
        body(landed, epoch)
    return spark.read.parquet(f"{root}/sinks/block_quarantine").select("raw", "reason")


REPLAYS = ("2024-01-01 00:00:00", "2024-01-05 00:00:00")


@register("replayed_sales", ev_sql(f"""
SELECT symbol, nft_id, CAST(price AS DOUBLE) AS price, price_symbol, counterparty AS seller, account AS buyer,
       he_block * 10 + tx_seq AS he_block, TIMESTAMP '{REPLAYS[0]}' AS ts
FROM ev WHERE op = 'market_buy'"""))
def q_replayed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a time, each with two sales of one instance, captured and redelivered with
    ingest times four days apart: one row a sale, the first of the block, with the first ingest time."""
    from ...operators import parse
    from ...streaming import capture
    root = fresh_dir(spark, "replay")
    e = parse.nft_events(fx_parsed(spark, sf_dir)).where("op = 'market_buy'")
    sale = lambda p: F.struct(F.col("nft_id").cast("string").alias("id"), p.cast("string").alias("price"),
                              F.col("price_symbol").alias("symbol"))
    data = F.struct("symbol", F.col("account"), F.array(F.struct(
        F.col("counterparty").alias("account"), F.array(sale(F.col("price")), sale(F.col("price") / 2)).alias("nftSales"))).alias("sellers"))
    logs = F.struct(F.array(F.struct(F.lit("nftmarket").alias("contract"), F.lit("hitSellOrder").alias("event"),
                                     data.alias("data"))).alias("events"))
    tx = F.struct(F.lit("nftmarket").alias("contract"), F.lit("buy").alias("action"), F.col("account").alias("sender"),
                  F.col("tx_id").alias("transactionId"), logs.alias("logs"))
    docs = e.select(F.to_json(F.struct((F.col("he_block") * 10 + F.col("tx_seq")).alias("blockNumber"),
                                       F.array(tx).alias("transactions"))).alias("value"))
    docs.write.text(f"{root}/landing")          # built once: both deliveries bring the same documents
    docs = spark.read.text(f"{root}/landing")
    for epoch, at in enumerate(REPLAYS):
        batch = docs.withColumn("ingest_ts", F.lit(at).cast("timestamp"))
        capture.BlockCapture(root, margin=0)(batch, epoch)
    return comparable(spark.read.parquet(f"{root}/market_sales").drop("bucket"))


@register("captured_status", ev_sql("""
SELECT 'last_live_block' AS metric, CAST(max(he_block) - 1 AS DOUBLE) AS value FROM ev
UNION ALL SELECT 'backfill_cursor_block', CAST(min(he_block) AS DOUBLE) FROM ev
UNION ALL SELECT 'backfill_target_block', CAST(min(he_block) AS DOUBLE) FROM ev
UNION ALL SELECT 'backfill_complete', 1.0
UNION ALL SELECT 'captured_events', CAST(count(*) AS DOUBLE) FROM ev WHERE he_block < (SELECT max(he_block) FROM ev)"""))
def q_captured_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6/E7 from progress rows: the newer half of the landed blocks captured live, the older half backfilled."""
    from ...operators import views
    from ...streaming import capture
    root = _landed_blocks(spark, sf_dir, "status")
    blocks = capture.read_blocks(spark, f"{root}/landing").where("blockNumber is not null")
    lo, hi = blocks.agg(F.min("blockNumber"), F.max("blockNumber")).first()
    mid = (lo + hi) // 2
    capture.BlockCapture(f"{root}/sink")(blocks.where(F.col("blockNumber") >= mid), 0)
    capture.run_backfill(spark, f"{root}/landing", f"{root}/sink", target=lo, chunk_blocks=hi, start_below=mid)
    progress, events = spark.read.parquet(f"{root}/sink/pipeline_state"), spark.read.parquet(f"{root}/sink/nft_events")
    cursor = views.backfill_cursor(progress).first()[0]
    cover = views.activity_coverage(events, backfill_cursor=cursor, backfill_target=lo)
    return views.pipeline_status([
        views.capture_freshness(progress).select("last_live_block"),
        cover.select("backfill_cursor_block", "backfill_target_block", F.col("backfill_complete").cast("int").alias("backfill_complete")),
        events.agg(F.count(F.lit(1)).alias("captured_events"))])


@register("backfill_quarantine", ORACLE["block_quarantine"])
def q_backfill_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill keeps the documents that cannot be a block, each once, whatever part of the range it walks."""
    from ...streaming import capture
    root = fresh_dir(spark, "backfill-quarantine")
    docs = fx.fx_block_docs(spark, sf_dir)
    _with_bad_documents(docs).write.text(f"{root}/landing")
    hi = docs.agg(F.max("he_block")).first()[0]
    capture.run_backfill(spark, f"{root}/landing", f"{root}/sink", target=hi // 2, chunk_blocks=hi, start_below=hi + 1)
    capture.run_backfill(spark, f"{root}/landing", f"{root}/sink", target=0, chunk_blocks=hi)
    return spark.read.parquet(f"{root}/sink/block_quarantine").select("raw", "reason")


@register("restarted_capture", ORACLE["stream_capture"])
def q_restarted_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches whose numbers start again, as with a new checkpoint on a message source. Each holds back its
    newest block, which only the next one can settle."""
    from ...streaming import capture
    root = fresh_dir(spark, "restart")
    docs = fx.fx_block_docs(spark, sf_dir)
    hi = docs.agg(F.max("he_block")).first()[0]
    third = F.least(F.floor(F.col("he_block") * 3 / (hi + 1)), F.lit(2))
    for k, epoch in enumerate((0, 41, 0)):
        batch = docs.where(third == k).select("value", F.lit(fx.BLOCK_INGEST_TS).cast("timestamp").alias("ingest_ts"))
        capture.BlockCapture(f"{root}/sinks")(batch, epoch)
    return comparable(spark.read.parquet(f"{root}/sinks/nft_events").drop("bucket"))


@register("start_at_tip", ev_sql("""
SELECT he_block, tx_seq, symbol, nft_id, op, account, counterparty, CAST(price AS DOUBLE) AS price,
       price_symbol, tx_id, bts AS ts FROM ev
WHERE he_block < (SELECT MAX(he_block) FROM ev) AND he_block >= (
  SELECT MAX(he_block) - 1 FROM ev WHERE he_block <= (SELECT MAX(he_block) // 2 FROM ev))"""))
def q_start_at_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture begins at the settled head of what had landed at its first start (half of the blocks), also after a
    restart with a new checkpoint when all have landed."""
    from ...streaming import capture
    root = fresh_dir(spark, "tip")
    docs = fx.fx_block_docs(spark, sf_dir)
    half = docs.agg(F.max("he_block")).first()[0] // 2
    for name, part in (("a", F.col("he_block") <= half), ("b", F.col("he_block") > half)):
        docs.where(part).select("value").write.text(f"{root}/landing/{name}")
        q = capture.start_capture(spark, f"{root}/landing/*", f"{root}/sinks", checkpoint=f"{root}/cp-{name}", starting_block=capture.TIP)
        q.awaitTermination()
    return comparable(spark.read.parquet(f"{root}/sinks/nft_events").drop("bucket"))
