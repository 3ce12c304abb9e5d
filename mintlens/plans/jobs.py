"""Table-level jobs: snapshots applied to stored tables, and open work kept up to date.

Holdings are stored by ``symbol`` and, inside a symbol, by a hash bucket of the instance (``write_holdings``). A refresh
can change only the buckets that hold rows of its confirmed scopes or receive fetched rows: the job reads which those
are (two narrow columns), applies the snapshot to them, cuts lineage with ``checkpoint()`` (written under
``spark.checkpoint.dir``), and replaces them alone (dynamic partition overwrite); files of other buckets are not
touched. Books are stored by ``symbol`` and replaced whole, as their snapshots are. The time of each scope's last
applied fetch is kept beside the table (``<path>_fetches``), so a fetch that arrives late changes nothing.

Partition lists handled on the driver are bounded by the catalog: symbols, or symbols x buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..session import checkpoint_dir
from ..sources.sinks import drop_partitions, gathered, read_if_exists, write_view

BUCKETS = 64            # of a symbol's holdings
STATE_BUCKETS = 64      # of the scope state


def nft_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("nft_id"), F.lit(int(buckets))).cast("int")


def write_holdings(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A holdings table for :func:`apply_holdings_table` (with the same ``buckets``). Each task writes whole buckets."""
    rows = df.withColumn("bucket", nft_bucket(buckets)).repartition("symbol", "bucket")
    write_view(rows, path, ["symbol", "bucket"])


def _fetch_log(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame | None:
    log = read_if_exists(spark, f"{path}_fetches")
    return None if log is None else log.where(F.col("symbol").isin(symbols))


def _log_fetches(conf: DataFrame, path: str) -> None:
    conf.write.mode("append").partitionBy("symbol").parquet(f"{path}_fetches")


def _symbols(conf: DataFrame) -> list[str]:
    return [r.symbol for r in conf.select("symbol").distinct().collect()]       # one a collection at most


def apply_holdings_table(spark: SparkSession, path: str, fetched: DataFrame, outcomes: DataFrame,
                         buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """C2/C3 on a table of :func:`write_holdings`; returns the replaced (symbol, bucket)s. Failed and late
    fetches touch no bucket."""
    checkpoint_dir(spark)
    keys = ["account", "symbol"]
    symbols = _symbols(state.confirmed_scopes(outcomes, keys))
    if not symbols:
        return []
    applied = _fetch_log(spark, path, symbols)
    conf = state.confirmed_scopes(outcomes, keys, applied).checkpoint(eager=True)
    stored = spark.read.parquet(path).where(F.col("symbol").isin(symbols))
    old = stored.select(*keys, "bucket").join(conf, keys, "left_semi").select("symbol", "bucket")
    new = fetched.select(*keys, "nft_id").join(conf, keys, "left_semi").select("symbol", nft_bucket(buckets).alias("bucket"))
    touched = sorted((r.symbol, r.bucket) for r in old.unionByName(new).distinct().collect())
    if touched:
        names = [f"{s}/{b}" for s, b in touched]
        in_touched = F.concat_ws("/", "symbol", "bucket").isin(names)       # on partition columns: prunes folders
        cols = [c for c in stored.columns if c != "bucket"]
        after = state.apply_holdings(stored.where(in_touched).select(*cols), fetched.select(*cols), outcomes, applied)
        after = after.withColumn("bucket", nft_bucket(buckets)).checkpoint(eager=True)
        left = {(r.symbol, r.bucket) for r in after.select("symbol", "bucket").distinct().collect()}
        if left:
            write_view(after.repartition("symbol", "bucket"), path, ["symbol", "bucket"])
        for s in sorted({s for s, _ in touched}):       # a dynamic overwrite leaves partitions without rows as they are
            gone = [str(b) for t, b in touched if t == s and (s, b) not in left]
            if gone:
                drop_partitions(spark, path, "symbol", [s], below=("bucket", gone))
    _log_fetches(conf, path)
    return touched


def apply_book_table(spark: SparkSession, path: str, orders: DataFrame, outcomes: DataFrame) -> list[str]:
    """C4 on an order-book table partitioned by ``symbol``: only the symbols
    with a confirmed snapshot, not older than their book, are rewritten."""
    checkpoint_dir(spark)
    symbols = _symbols(state.confirmed_scopes(outcomes, ["symbol"]))
    if not symbols:
        return []
    applied = _fetch_log(spark, path, symbols)
    conf = state.confirmed_scopes(outcomes, ["symbol"], applied).checkpoint(eager=True)
    confirmed = _symbols(conf)
    if not confirmed:
        return []
    cur = spark.read.parquet(path).where(F.col("symbol").isin(confirmed))
    cols = [c for c in cur.columns if c != "symbol"] + ["symbol"]
    new = state.apply_book(cur.select(*cols), orders, outcomes, applied).select(*cols).where(F.col("symbol").isin(confirmed))
    new = new.checkpoint(eager=True)
    kept = set(_symbols(new))
    if kept:
        write_view(new, path, ["symbol"])
    drop_partitions(spark, path, "symbol", [s for s in confirmed if s not in kept])
    _log_fetches(conf, path)
    return confirmed


# -- C12 -----------------------------------------------------------------------

def update_block_runs(spark: SparkSession, path: str, blocks: DataFrame, bucket_blocks: int = state.BLOCKS_PER_DAY) -> list[int]:
    """C12/I4 kept up to date: the block numbers of a batch merged into the captured runs stored at ``path``, whose
    partitions hold a day at least: one bucket, or as many small ones. Only the batch's partitions are read and replaced;
    the same batch again changes nothing. Returns the replaced partitions."""
    checkpoint_dir(spark)
    size, of_day = int(bucket_blocks), max(1, state.BLOCKS_PER_DAY // int(bucket_blocks))
    day = F.floor(F.col("bucket") / of_day).cast("bigint")
    new = state.block_runs(blocks, size).checkpoint(eager=True)
    hit = sorted(r.day for r in new.select(day.alias("day")).distinct().collect())       # days of one batch
    if not hit:
        return []
    old = read_if_exists(spark, path)
    if old is not None:
        old = old.where(F.col("bucket").isin(hit)).select(F.floor(F.col("lo") / size).cast("bigint").alias("bucket"), "lo", "hi")
        new = state.merge_runs(new.unionByName(old.select(*new.columns))).checkpoint(eager=True)
    write_view(new.withColumn("bucket", day).repartition("bucket"), path, ["bucket"])
    return hit


# -- C7 ------------------------------------------------------------------------

def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("account"), F.lit(int(buckets))).cast("int"))


def scope_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scopes, failures) of a stored scope state; empty frames before its first update."""
    out = []
    for name, ddl in (("scopes", state.SCOPE_DDL), ("failures", state.FAILURE_DDL)):
        found = read_if_exists(spark, f"{path}/{name}")
        out.append(spark.createDataFrame([], f"{ddl}, bucket int") if found is None else found)
    return out[0], out[1]


def update_scope_state(spark: SparkSession, path: str, touches: DataFrame, outcomes: DataFrame, batch: int,
                       buckets: int = STATE_BUCKETS) -> list[int]:
    """C7 kept up to date: fold the new rows of both logs into the state stored at ``path``. Only the buckets
    of accounts that the new rows name are read and replaced. ``batch`` numbers the update: one that is run again
    after a crash changes nothing more. Returns the replaced buckets."""
    checkpoint_dir(spark)
    names = touches.select("account").unionByName(outcomes.select("account"))
    hit = sorted(r.bucket for r in _bucketed(names, buckets).select("bucket").distinct().collect())     # ``buckets`` at most
    if not hit:
        return []
    scopes, failures = (df.where(F.col("bucket").isin(hit)).drop("bucket") for df in scope_state(spark, path))
    folded, still = state.fold_scopes(scopes, failures, touches, outcomes, batch)
    # buckets larger than a task's share are written by several
    folded, still = _bucketed(folded, buckets), _bucketed(still, buckets).checkpoint(eager=True)
    write_view(gathered(folded, ["bucket"]), f"{path}/scopes", ["bucket"])
    left = {r.bucket for r in still.select("bucket").distinct().collect()}
    if left:
        write_view(gathered(still, ["bucket"]), f"{path}/failures", ["bucket"])
    drop_partitions(spark, f"{path}/failures", "bucket", [str(b) for b in hit if b not in left])
    return hit
