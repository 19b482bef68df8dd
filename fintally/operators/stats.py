"""Exact order statistics per group without sorting a whole group in one task.

``kth_smallest`` counts equal values first (a partial aggregate: a hot group is combined map-side),
then finds the bucket that holds the wanted rank, then the value inside the bucket. Buckets are
floating-point like (the position of the leading bit and the ``BUCKET_BITS`` bits behind it), so a
group has at most 64 * 2^BUCKET_BITS of them and any non-negative 64-bit integer is covered.
Everything is lazy: one plan, no job while it is built.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 10


def _bucket(v: Column) -> Column:
    """A number that never falls as ``v`` grows: leading-bit position, then the next bits."""
    top = F.length(F.bin(v)) - 1
    drop = F.greatest(top - BUCKET_BITS, F.lit(0))
    high = F.call_function("shiftright", v, drop)
    return top.cast("long") * F.lit(1 << (BUCKET_BITS + 1)) + high


def kth_smallest(values: DataFrame, keys: list[str], value: str, targets: DataFrame) -> DataFrame:
    """For each target row (keys..., tag, rank) return (keys..., tag, rank, kth) where
    ``kth`` is the value at 0-based position ``rank`` of the group's values in ascending
    order (duplicates counted). ``value`` must be a non-negative integral column; ranks outside
    [0, n) give no row.
    """
    counts = (values.select(*keys, F.col(value).cast("long").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_bucket", _bucket(F.col("_v"))))

    def running(df: DataFrame, group: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_hi", F.sum("_n").over(w)).withColumn("_lo", F.col("_hi") - F.col("_n"))

    buckets = running(counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n")), keys, "_bucket")
    wanted = targets.select(*keys, "tag", F.col("rank").cast("long").alias("rank"))
    inside = (F.col("_lo") <= F.col("_rank")) & (F.col("_rank") < F.col("_hi"))
    # without keys all targets belong to one group
    lit_key = [] if keys else ["_all"]
    if lit_key:
        wanted, buckets, counts = (d.withColumn("_all", F.lit(0)) for d in (wanted, buckets, counts))
    group = [*keys, *lit_key]
    found = (wanted.withColumn("_rank", F.col("rank")).join(buckets.drop("_n"), group).filter(inside)
             .select(*group, "tag", "rank", "_bucket", (F.col("_rank") - F.col("_lo")).alias("_rank")))
    near = counts.join(found.select(*group, "_bucket").distinct(), [*group, "_bucket"], "left_semi")
    return (found.join(running(near, [*group, "_bucket"], "_v"), [*group, "_bucket"]).filter(inside)
            .select(*keys, "tag", "rank", F.col("_v").alias("kth")))
