"""SparkSession construction and cluster-shared settings."""
from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every fintally job relies on; a cluster session may already carry them.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # partition sizing for large inputs: AQE starts from many shuffle partitions and
    # coalesces them to ~256 MB; scans read ~256 MB splits; a skewed join partition is split
    # once it is 5x the median and over 512 MB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fintally", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the fintally defaults.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster the submitter
    decides both and they should be left as ``None``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster configures it (a shared filesystem). Only a local master, where driver and
    executors are one process, gets a scratch folder when nothing is configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="fintally-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint location for one run's intermediate files."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fintally-scratch/{name}-{uuid.uuid4().hex[:12]}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as a local path if it lies in a (mounted) local file system, else None."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    return path if path.startswith("/") and default.startswith("file:") else None


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as a table in the shared folder and read from there: work behind it is done once, and
    lost executors don't undo it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
