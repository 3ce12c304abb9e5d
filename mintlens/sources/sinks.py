"""Sinks (A6-A8): idempotent append, per-partition replacement, JSON rendering.

``append_idempotent`` is what makes replays safe: a re-processed block (a
restarted stream, a re-run backfill, a retried batch after an executor loss)
adds nothing, because rows whose key already exists in the sink are removed
by an anti join before the append. The existing-key side is pruned to the key
range of the incoming rows first (filters on the range column reach the
parquet scan as pushed filters), so the join does not grow with the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decimal_text, iso_ts


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The sink, or None before its first write (no folder, or none with a file). Any other error is raised:
    taking it for an empty sink would append everything again."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def partition_values(spark: SparkSession, path: str, part_col: str) -> list[str]:
    """The values of a partition column that have a folder, as folder text."""
    hpath, fs = _hadoop_fs(spark, path)
    if not fs.exists(hpath):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()]
    return [n.split("=", 1)[1] for n in found if n.startswith(part_col + "=")]


def read_buckets(spark: SparkSession, path: str, part_col: str, buckets: Collection[int], schema: T.StructType) -> DataFrame | None:
    """The partitions of a sink whose ``part_col`` is among ``buckets``, by their folders and with a known schema:
    neither the other partitions nor any file footer is looked at. None if there are none."""
    folders = [f"{path}/{part_col}={v}" for v in partition_values(spark, path, part_col) if int(v) in buckets]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else None


def dedupe_keys(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key; among differing duplicates the smallest ``order``
    tuple wins (deterministic, unlike insertion order)."""
    rest = [c for c in df.columns if c not in key]
    order = order or rest
    if not rest:
        return df.dropDuplicates(key)
    return (df.groupBy(*key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r"))
            .select(*key, "_r.*").select(*df.columns))


def gathered(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows of one sink partition brought together before they are written, so that a write leaves about a file a
    partition, not one for each partition in each task. The rows of a large partition are split over tasks again."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def append_idempotent(spark: SparkSession, new: DataFrame, path: str, key: list[str],
                      order: list[str] | None = None, range_col: str | None = None,
                      partition_by: list[str] | None = None, bounds: tuple | None = None,
                      unique: bool = False, buckets: Collection[int] | None = None, drop: tuple[str, ...] = (),
                      arrange: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Insert rows whose key is not yet in the sink (ON CONFLICT DO
    NOTHING), de-duplicated within the batch. ``bounds`` = the (lo, hi) of
    ``range_col`` in the batch when the caller already knows it; ``unique``
    = the key is unique within the batch by construction (no dedupe shuffle);
    ``buckets`` = the values of the integer partition column that
    the batch can collide with: only those partitions are read; ``drop`` =
    columns that order the duplicates and are not stored; ``arrange`` = how the
    rows that are left are partitioned and sorted for writing (if None, ``gathered`` by ``partition_by``)."""
    rows = (new if unique else dedupe_keys(new, key, order)).drop(*drop)
    if buckets is None:
        existing = read_if_exists(spark, path)
    else:
        existing = read_buckets(spark, path, partition_by[0], buckets, rows.schema)
    if existing is not None:
        have = existing.select(*key)
        if range_col is not None:
            lo, hi = bounds if bounds is not None else rows.agg(F.min(range_col), F.max(range_col)).first()
            if lo is None:
                return
            have = have.where(F.col(range_col).between(lo, hi))
        rows = rows.join(have, key, "left_anti")
    if arrange is None and partition_by:
        arrange = lambda df: gathered(df, partition_by)
    w = (rows if arrange is None else arrange(rows)).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_view(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions (e.g. symbols) present in ``df``;
    all other partitions stay (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def render_for_json(c: F.Column, dtype: T.DataType) -> F.Column:
    """A8 value rendering at any depth: decimals as trimmed text, timestamps
    as ISO-8601 with offset; structs, arrays and maps are rebuilt with
    ``struct`` / ``transform`` / ``transform_values`` (no UDF)."""
    if isinstance(dtype, T.DecimalType):
        return decimal_text(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_ts(c)
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[render_for_json(c[f.name], f.dataType).alias(f.name)
                                                for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType) and _needs_render(dtype.elementType):
        return F.transform(c, lambda x: render_for_json(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _needs_render(dtype.valueType):
        return F.transform_values(c, lambda _k, v: render_for_json(v, dtype.valueType))
    return c


def _needs_render(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.DecimalType, T.TimestampType, T.TimestampNTZType)):
        return True
    if isinstance(dtype, T.StructType):
        return any(_needs_render(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _needs_render(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _needs_render(dtype.valueType)
    return False


def to_json_view(df: DataFrame, col_name: str = "json") -> DataFrame:
    """One JSON document per row, decimals as trimmed text ("7", "9.9"),
    timestamps as ISO-8601 with offset, at any nesting depth; null fields are written as null, VARIANT
    values with their JSON type."""
    cols = [render_for_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(col_name))


def compact(spark: SparkSession, path: str, part_col: str, files_at_most: int = 8, target_files: int = 1) -> list[str]:
    """Rewrite the partitions of a sink that many small appends have left in more than ``files_at_most`` files, as
    ``target_files`` each; rows and other partitions stay as they are. Returns the values rewritten. Run it while nothing
    appends, like retention."""
    many = []
    for value in partition_values(spark, path, part_col):
        hpath, fs = _hadoop_fs(spark, f"{path}/{part_col}={value}")
        if sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(hpath)) > files_at_most:
            many.append(value)
    for value in many:      # one partition a job: what is rewritten is bounded, and a crash loses none
        rows = spark.read.parquet(path).where(F.col(part_col).cast("string") == unquote(value)).checkpoint(eager=True)
        write_view(rows.repartition(target_files), path, [part_col])
    return many


def _hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop FileSystem of ``path`` (works for local, HDFS and object-store
    paths); needs a classic session with a JVM."""
    try:
        sc = spark.sparkContext
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        return hpath, hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    except Exception as exc:  # noqa: BLE001
        raise RuntimeError("partition folders can only be removed from a classic Spark session") from exc


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder with everything in it."""
    hpath, fs = _hadoop_fs(spark, path)
    fs.delete(hpath, True)


def drop_partitions(spark: SparkSession, path: str, part_col: str, values: list[str],
                    below: tuple[str, list[str]] | None = None) -> list[str]:
    """Delete the ``part_col=<value>`` folders for the given values (Spark
    escapes special characters in folder names; they are unescaped here). With ``below`` = (column, values) only
    those second-level partitions inside them are deleted."""
    hpath, fs = _hadoop_fs(spark, path)
    wanted, removed = set(values), []
    if not fs.exists(hpath):
        return removed
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(part_col + "=") and unquote(name.split("=", 1)[1]) in wanted:
            if below is not None:
                removed += [f"{name}/{n}" for n in drop_partitions(spark, st.getPath().toString(), *below)]
                continue
            fs.delete(st.getPath(), True)
            removed.append(name)
    return removed
