"""Helpers shared by the operators: scratch tables and reading of inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is
    cut, and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """``stems``, each with as many ``_`` before it as make it differ from every column of ``df`` (upper and lower
    case alike, as Spark resolves names)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch. Texts are long: ten thousand of them, Spark's own setting, are tens of MB in every
#: buffer between the JVM and a Python worker.
BATCH_ROWS = 2000
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship_code(spark: SparkSession) -> None:
    """Hands this package's modules to the Python workers, once an application, so that functions
    in them can be imported there wherever the driver has imported them from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    folder = tempfile.TemporaryDirectory(prefix="code-")     # the driver serves the file from here
    path = os.path.join(folder.name, f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = folder


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers, and batches of at most BATCH_ROWS rows
    in this session."""
    spark = df.sparkSession
    ship_code(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def keep_rows(df: DataFrame, column: str, keep: Callable) -> DataFrame:
    """Rows of ``df`` for which ``keep`` holds. ``keep`` is called once in a task and returns a function from an
    Arrow array of ``column`` to a list of booleans; no row leaves its task, whatever its other columns hold."""
    at = df.columns.index(column)

    def run(batches):
        test = keep()
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at)), pa.bool_()))

    return map_arrow(df, run, df.schema)
