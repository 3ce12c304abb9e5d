"""Structured Streaming capture of landed blocks.

Blocks land as JSON lines in a folder (the bronze landing zone that replaces
node calls). ``start_capture`` reads them with ``readStream`` and processes
each micro-batch in ``foreachBatch``:

1. settle margin (I3): blocks within ``margin`` of the highest number seen
   are held back in a small table and re-enter the next batch, whatever its number;
2. parse once (B14, where the documents were read, cached for the batch) into activity rows, sales,
   touched scopes and market flags; copies of a block are left out by their numbers;
3. append every output with :func:`append_idempotent` (A6), so replays after
   a crash or a lost executor add nothing (I5); documents that are no block go to ``block_quarantine``;
4. record progress (last settled block) in a ``pipeline_state`` table.

Backfill (I7, C13) runs the same batch function over a historical range in
``mode='backfill'``: activity and sales only, no scopes and no dirty flags.
No watermark is used: late blocks are accepted at any age and de-duplicated
by key (a watermark would drop them).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import parse
from ..plans.jobs import update_block_runs
from ..session import scratch_path
from ..sources.sinks import append_idempotent, drop_partitions, partition_values, read_if_exists, remove_folder

SETTLE_MARGIN = 1
TIP = "tip"                     # start at the settled head of what has landed
QUARANTINE_BUCKETS = 64
UNUSABLE = -1                   # the staged chunk of documents that cannot be a block
BLOCKS_PER_BUCKET = 28800       # blocks of a sink partition: a day at one block in three seconds


def landed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents as text, one a row: (value, file, ingest_ts)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_modification_time").alias("ingest_ts"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A1 (batch): landed block documents, with the file time as ingest time. Documents that cannot be a block are in
    ``parse.unusable_documents(landed_lines(spark, path))``: every landed document is in one of the two."""
    return parse.usable_blocks(landed_lines(spark, path), ingest_ts=F.col("ingest_ts"))


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1 (stream): landed documents as text with file and ingest time, as a streaming source."""
    r = spark.readStream.option("maxFilesPerTrigger", int(max_files_per_trigger)) if max_files_per_trigger else spark.readStream
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                               F.col("_metadata.file_modification_time").alias("ingest_ts"))


def stream_blocks(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1 (stream): the same documents as typed blocks."""
    return parse.usable_blocks(stream_lines(spark, path, max_files_per_trigger), ingest_ts=F.col("ingest_ts"))


def content_hash(blocks: DataFrame) -> F.Column:
    """Orders copies of a block that differ, the same way on every run; the ingest time is no content."""
    return F.xxhash64(*[c for c in blocks.columns if c not in ("blockNumber", "ingest_ts")])


def one_copy(blocks: DataFrame) -> DataFrame:
    """One copy of each block number (for the few held blocks; a batch is parsed first, see ``first_copies``)."""
    rest = [c for c in blocks.columns if c != "blockNumber"]
    order = F.struct(content_hash(blocks), *[c for c in ("ingest_ts",) if c in rest])
    return blocks.groupBy("blockNumber").agg(F.min_by(F.struct(*rest), order).alias("_b")).select("blockNumber", "_b.*").select(
        *blocks.columns)


COPY_COLS = ("_copy", "_row")


def first_copies(parsed: DataFrame) -> DataFrame:
    """One row a block of a (persisted) parse that carries ``COPY_COLS``. Only numbers are shuffled: (block, copy) once to find
    blocks that came more than once, and their surplus rows to leave them out; landed documents never are."""
    first = parsed.groupBy("he_block").agg(F.min(F.struct(*COPY_COLS)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not first.limit(1).count():
        return parsed.drop(*COPY_COLS)
    surplus = parsed.select("he_block", *COPY_COLS).join(first, "he_block").where(F.struct(*COPY_COLS) != F.col("_first"))
    return parsed.join(surplus.select("he_block", "_row"), ["he_block", "_row"], "left_anti").drop(*COPY_COLS)


def block_bucket(block: F.Column, size: int = BLOCKS_PER_BUCKET) -> F.Column:
    """The sink partition of a block: about a day of blocks. It depends on the block number alone, so a block
    that is captured again, with whatever time, meets its earlier rows."""
    return F.floor(block / size).cast("bigint")


def judge(docs: DataFrame) -> DataFrame:
    """Text documents by the one rule of ``parse.judged_documents``; the text is kept of unusable ones only."""
    ingest = F.col("ingest_ts") if "ingest_ts" in docs.columns else F.lit(None).cast("timestamp")
    judged = parse.judged_documents(docs, file_col="file" if "file" in docs.columns else None, ingest_ts=ingest)
    return judged.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


class BlockCapture:
    """The foreachBatch body; also usable directly on a batch DataFrame of typed blocks, or of
    text documents (``value``, optionally ``file`` and ``ingest_ts``), whose unusable ones go to the
    ``block_quarantine`` sink."""

    def __init__(self, sink_root: str, mode: str = "live", margin: int = SETTLE_MARGIN,
                 starting_block: int | str | None = None, bucket_blocks: int = BLOCKS_PER_BUCKET):
        if mode not in ("live", "backfill"):
            raise ValueError("mode must be 'live' or 'backfill'")
        if isinstance(starting_block, str) and starting_block != TIP:
            raise ValueError(f"starting_block must be a number, {TIP!r} or None")
        self.root = sink_root
        self.mode = mode
        self.margin = int(margin)
        self.starting_block = starting_block
        self.bucket_blocks = int(bucket_blocks)

    def captured(self, spark: SparkSession, parsed: DataFrame) -> None:
        """I4: the numbers of settled blocks, as runs (``block_runs``)."""
        update_block_runs(spark, self.path("block_runs"), parsed.select("he_block"), self.bucket_blocks)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def first_block(self, spark: SparkSession, blocks: DataFrame) -> int | None:
        """The block at which capture begins. ``"tip"`` is fixed once, at the first start, as the settled head of
        what has landed by then, and kept beside the sinks: a later start, with whatever checkpoint, begins there too."""
        if self.starting_block != TIP:
            return self.starting_block
        fixed = read_if_exists(spark, self.path("capture_start"))
        if fixed is not None:
            return fixed.agg(F.min("block")).first()[0]
        head = blocks.agg(F.max("blockNumber")).first()[0]
        if head is None:
            return None
        start = max(0, head - self.margin)
        spark.range(1).select(F.lit(start).cast("bigint").alias("block")).write.parquet(self.path("capture_start"))
        return start

    def held(self, spark: SparkSession) -> DataFrame | None:
        """The blocks held back so far. They are a table of their own, whatever the numbers of batches or
        checkpoints were: each batch reads them all and leaves those that have not settled."""
        found = read_if_exists(spark, self.path("held"))
        return None if found is None else found.drop("run")

    def hold(self, spark: SparkSession, blocks: DataFrame) -> None:
        """Replaces the held table. The new run is complete before older ones go; if both are left by a crash, the next
        batch reads both, and blocks that have settled meanwhile meet their rows in the sinks."""
        runs = partition_values(spark, self.path("held"), "run")
        new = max([-1, *map(int, runs)]) + 1
        one_copy(blocks).write.mode("overwrite").parquet(self.path(f"held/run={new}"))
        drop_partitions(spark, self.path("held"), "run", runs)

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        settle = self.margin > 0 and self.mode == "live"
        if "value" in batch.columns:
            judged = judge(batch).persist()
            self.quarantine(spark, judged)
            blocks = judged.where(F.col("reason").isNull()).drop("file", "raw", "reason")
        else:
            # typed blocks that are read once, as in a backfill, are parsed as they come
            judged = batch.persist() if settle or self.starting_block == TIP else None
            blocks = batch.where(F.col("blockNumber").isNotNull())
        start = self.first_block(spark, blocks)
        if start is not None:
            blocks = blocks.where(F.col("blockNumber") >= int(start))
        held = self.held(spark) if settle else None
        if held is not None:
            blocks = blocks.unionByName(held.select(*blocks.columns))
        # documents are parsed where they were read; copies of a block are told apart afterwards, by numbers
        order = F.struct(content_hash(blocks).alias("content"), *[c for c in ("ingest_ts",) if c in blocks.columns])
        numbered = blocks.withColumn("_copy", order).withColumn("_row", F.monotonically_increasing_id())
        # what no sink takes is not computed: unknown names, and in a backfill (C13) the scopes
        unused = ("unknown",) if self.mode == "live" else ("unknown", "scopes")
        every = parse.parse_blocks(numbered, keep=COPY_COLS).drop(*unused).persist()
        try:
            # one pass over the parse gives the head (for the settle cut) and
            # the block range (for pruning the idempotency checks)
            r = every.agg(F.min("he_block").alias("lo"), F.max("he_block").alias("hi")).first()
            hi = r["hi"]
            parsed = first_copies(every)
            if settle and hi is not None:
                hi = int(hi) - self.margin
                parsed = parsed.where(F.col("he_block") <= hi)
            if hi is not None and r["lo"] <= hi:
                self.write_outputs(spark, parsed, (r["lo"], hi))
                self.captured(spark, parsed)
            if settle and hi is not None:
                self.hold(spark, blocks.where(F.col("blockNumber") > hi))
            (spark.range(1).select(F.lit(epoch_id).alias("epoch"), F.lit(self.mode).alias("mode"),
                                   F.lit(r["lo"]).cast("bigint").alias("first_block"),
                                   F.lit(hi).cast("bigint").alias("last_block"),
                                   F.current_timestamp().alias("updated_at"))
             .write.mode("append").parquet(self.path("pipeline_state")))
        finally:
            every.unpersist()
            if judged is not None:
                judged.unpersist()

    def quarantine(self, spark: SparkSession, judged: DataFrame) -> None:
        """The documents that cannot be a block are kept, once each, with the reason and the file they landed in. The
        sink is partitioned by a hash of the text; a batch reads only the partitions that its own bad documents fall in."""
        bad = judged.where(F.col("reason").isNotNull()).groupBy("raw").agg(F.min("file").alias("file"), F.min("reason").alias("reason"))
        bad = bad.select("raw", "file", "reason", F.sha2("raw", 256).alias("id"),
                         F.pmod(F.xxhash64("raw"), F.lit(QUARANTINE_BUCKETS)).cast("int").alias("part")).persist()
        hit = [r["part"] for r in bad.select("part").distinct().collect()]      # QUARANTINE_BUCKETS at most
        if hit:
            append_idempotent(spark, bad, self.path("block_quarantine"), ["id"], unique=True, partition_by=["part"], buckets=hit)
        bad.unpersist()

    def write_outputs(self, spark: SparkSession, parsed: DataFrame, bounds: tuple) -> None:
        """Append every output. Sinks are partitioned by block bucket; the idempotency check reads only the
        partitions of the batch's buckets, with a known schema. Activity keys (he_block, tx_seq), per-block
        scopes and flags are unique by construction (blocks were de-duplicated)."""
        def put(df, name, key, unique, order=None, drop=()):
            append_idempotent(spark, df.withColumn("bucket", block_bucket(F.col("he_block"), self.bucket_blocks)), self.path(name), key, order=order,
                              range_col="he_block", partition_by=["bucket"], bounds=bounds, unique=unique,
                              buckets=range(bounds[0] // self.bucket_blocks, bounds[1] // self.bucket_blocks + 1), drop=drop)

        ev = parse.nft_events(parsed)
        put(ev, "nft_events", ["he_block", "tx_seq"], True)
        put(parse.price_quarantine(parsed), "price_quarantine", ["he_block", "tx_seq"], True)
        # of two sales of one instance in a block, the first in the block counts
        put(parse.market_sales(parsed, with_pos=True), "market_sales", ["symbol", "nft_id", "he_block"], False,
            order=["sale_pos"], drop=("sale_pos",))
        put(parse.sales_quarantine(parsed), "quarantine", ["he_block", "sale_pos"], True)
        if self.mode == "live":
            put(parse.touch_scopes(parsed), "touch_scopes", ["he_block", "account", "symbol"], True)
            # live-only flags (C8): backfilled history must not mark books dirty
            flags = (ev.where(F.col("op").startswith("market_"))
                     .groupBy("he_block", "symbol").agg(F.max("ts").alias("flagged_at")))
            put(flags, "market_flags", ["he_block", "symbol"], True)


def start_capture(spark: SparkSession, landing, sink_root: str, checkpoint: str | None = None,
                  mode: str = "live", margin: int = SETTLE_MARGIN, starting_block: int | str | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the capture stream (``availableNow`` drains what has landed
    and stops; otherwise a processing-time trigger keeps running).

    ``landing`` is a folder of JSON-lines block documents, or any streaming
    DataFrame with a string column ``value`` holding one document per row
    (e.g. a message-bus source: ``readStream.format(...).load()
    .selectExpr("CAST(value AS STRING) AS value", "timestamp AS ingest_ts")``). Its ``ingest_ts`` is the block
    time of documents without a good one and must come from the source, so that a redelivery gives the same rows.

    ``starting_block``: a number, None (the oldest landed block), or ``"tip"`` (I2): the settled head, read from the whole
    folder at the first start, or from the first batch of a document stream."""
    cp = checkpoint or scratch_path(spark, "capture-checkpoint")
    body = BlockCapture(sink_root, mode=mode, margin=margin, starting_block=starting_block)
    if isinstance(landing, DataFrame):
        if "ingest_ts" not in landing.columns:
            raise ValueError("a document stream needs an ingest_ts column from its source")
        source = landing
    else:
        source = stream_lines(spark, landing, max_files_per_trigger)
        if starting_block == TIP:
            body.first_block(spark, read_blocks(spark, landing))
    w = source.writeStream.foreachBatch(body).option("checkpointLocation", cp)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def backfill(spark: SparkSession, blocks: DataFrame, sink_root: str, epoch_id: int = 0,
             bucket_blocks: int = BLOCKS_PER_BUCKET) -> None:
    """Capture-only run over historical blocks (no scopes, no flags)."""
    BlockCapture(sink_root, mode="backfill", margin=0, bucket_blocks=bucket_blocks)(blocks, epoch_id)


def run_backfill(spark: SparkSession, landing: str, sink_root: str, target: int, chunk_blocks: int,
                 start_below: int | None = None) -> int:
    """Walk landed blocks backwards from the current cursor (the lowest
    block already backfilled, else ``start_below``) down to ``target`` in
    chunks of ``chunk_blocks``; each chunk is one distributed capture-only job.
    The landing zone is read once: the blocks of the range are staged in a table with one partition a chunk,
    and a chunk reads its partition only; documents that cannot be a block are staged beside them and go to the
    quarantine. Restartable: the cursor is read back from the progress rows. Returns the final cursor."""
    state = read_if_exists(spark, os.path.join(sink_root, "pipeline_state"))
    cursor = None
    if state is not None:
        cursor = state.where(F.col("mode") == "backfill").agg(F.min("first_block")).first()[0]
    if cursor is None:
        if start_below is None:
            raise ValueError("no backfill progress yet: give start_below (e.g. the live start block)")
        cursor = int(start_below)
    epoch = 0 if state is None else int(state.agg(F.max("epoch")).first()[0] or 0) + 1
    if cursor <= target:
        return cursor
    top, size = cursor, int(chunk_blocks)
    judged = judge(landed_lines(spark, landing))
    number = F.col("blockNumber")
    chunk = F.when(F.col("reason").isNotNull(), F.lit(UNUSABLE)).when(
        number.between(int(target), top - 1), F.floor((F.lit(top - 1) - number) / size).cast("int"))
    staged = scratch_path(spark, f"backfill-blocks-{uuid.uuid4().hex}")
    judged.withColumn("chunk", chunk).where(F.col("chunk").isNotNull()).write.partitionBy("chunk").parquet(staged)
    schema = T.StructType([*judged.schema.fields, T.StructField("chunk", T.IntegerType())])
    read = lambda k: spark.read.schema(schema).parquet(staged).where(F.col("chunk") == k).drop("chunk")
    BlockCapture(sink_root, mode="backfill").quarantine(spark, read(UNUSABLE))
    for k in range(-(-(top - int(target)) // size)):
        backfill(spark, read(k).drop("file", "raw", "reason"), sink_root, epoch)
        # the cursor moves over the whole chunk, also where its lowest blocks never landed
        cursor, epoch = max(int(target), top - (k + 1) * size), epoch + 1
    remove_folder(spark, staged)
    return cursor


def retain_sink(spark: SparkSession, path: str, as_of, days: int = 30) -> list[str]:
    """Retention of a sink by whole buckets -- those whose newest row is older than the window are
    dropped (readers apply the exact window with ``state.retain``). Returns the removed folder names."""
    import datetime as dt
    t = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    cutoff = t - dt.timedelta(days=int(days))
    newest = spark.read.parquet(path).groupBy("bucket").agg(F.max("ts").alias("newest"))     # one row a bucket
    old = [str(r["bucket"]) for r in newest.where(F.col("newest") < F.lit(cutoff)).select("bucket").toLocalIterator()]
    return drop_partitions(spark, path, "bucket", old)
