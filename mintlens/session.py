"""Session construction and the few settings every job relies on.

Results depend on two settings: the session time zone (UTC, so parsed block
timestamps and the driver's naive timestamps line up) and ANSI mode (Spark 4
default, so bad casts are explicit ``try_cast`` calls, never silent NULLs).
Everything else is performance tuning that a cluster deployment overrides.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library needs regardless of deployment.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # of a key that a JSON object repeats, the last value counts, at every depth
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str = "local[8]", app: str = "mintlens",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own builder and call
    :func:`configure` on the resulting session instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we only read it. A private
    folder is created only when the setting is absent *and* the master is
    local (tests, local runs); on a cluster a missing setting is an error,
    never a machine-local fallback.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        path = path or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 -- no SparkContext (e.g. a remote session)
        pass
    if not path:
        master = sc.master if sc is not None else ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (it names where lineage is cut "
                               "and where scratch tables are written)")
        path = _LOCAL_FALLBACK.get("dir")
        if path is None:
            path = tempfile.mkdtemp(prefix="mintlens-ckpt-")
            _LOCAL_FALLBACK["dir"] = path
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_LOCAL_FALLBACK: dict[str, str] = {}


# Sizing for large inputs: post-shuffle partitions of ~256 MB, scan splits of
# 256 MB (JSON landing files are splittable line by line).
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def suggest_shuffle_partitions(input_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES,
                               minimum: int = 8) -> int:
    """Initial shuffle partition count for an input of ``input_bytes``; AQE
    then coalesces small partitions and splits skewed ones at runtime."""
    return max(minimum, -(-int(input_bytes) // int(target_bytes)))


def scale_conf(input_bytes: int) -> dict[str, str]:
    """Settings for a large run (e.g. 100 TB on a big cluster): partitions
    sized from the input, AQE advisory size, scan split size, skew-join
    thresholds, and a broadcast threshold kept modest."""
    return {
        "spark.sql.shuffle.partitions": str(suggest_shuffle_partitions(input_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables that cut
    lineage (used instead of machine-local temporary folders)."""
    return os.path.join(checkpoint_dir(spark), name)
