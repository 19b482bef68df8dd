"""Ledger, log and vector tables on shared storage (parquet), and their scans."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _append(df: DataFrame, path: str, by: list[str], batch: str | None) -> None:
    """Appends, or, with a batch id, replaces what an earlier run of that batch wrote."""
    if batch is None:
        out = df.write.mode("append")
    else:
        df, by = df.withColumn("batch", F.lit(batch)), [*by, "batch"]
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*by) if by else out).parquet(path)


def sink_append_ledger(txns: DataFrame, path: str, batch: str | None = None) -> None:
    """Append transactions, partitioned by month so date-range scans prune partitions. A ``batch`` that is run
    again (with the same rows) replaces its own."""
    _append(txns.withColumn("month", F.date_format("date", "yyyy-MM")), path, ["month"], batch)


def src_ledger_scan(spark: SparkSession, path: str, start: dt.date | None = None,
                    end: dt.date | None = None) -> DataFrame:
    """Inclusive date-range scan; the month bounds prune partitions, the date filter is pushed
    into the parquet reader."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("month") >= start.strftime("%Y-%m")) & (F.col("date") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("month") <= end.strftime("%Y-%m")) & (F.col("date") <= F.lit(end)))
    return df.drop("month", "batch")


def sink_append_log(log: DataFrame, path: str, batch: str | None = None) -> None:
    """Append categorisation log rows (neighbour ids as ARRAY<LONG>)."""
    _append(log, path, [], batch)


def sink_append_vectors(vectors: DataFrame, path: str, batch: str | None = None) -> None:
    _append(vectors, path, [], batch)


def src_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Vector table scan; rows whose vector length differs from ``dim`` are flagged."""
    df = spark.read.parquet(path)
    if dim is not None:
        df = df.withColumn("dim_ok", F.size("vector") == dim)
    return df
