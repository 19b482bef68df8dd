"""Recurring-payment detection over (merchant, amount) groups.

A group with m gaps between its sorted dates is recurring at the first known interval k
(in list order) with |mean gap - k| <= tol and sample stdev <= tol (tol = 7 for yearly,
else 3). Both tests are done exactly in integers: with S = sum of gaps and Q = sum of
squared gaps, |S - k m| <= tol m and m Q - S^2 <= tol^2 m (m - 1).

Skew-safe: rows are first reduced to distinct (merchant, amount, date) with a count — the
gaps inside one day are zero and add nothing to S or Q — so the gap window runs over at
most one row per calendar day of a group, however many rows the group holds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fintally.schema import (RECURRING_INTERVALS, RECURRING_LONG_TOLERANCE_DAYS,
                             RECURRING_MIN_OCCURRENCES, RECURRING_TOLERANCE_DAYS)

_TYPES = {7: "weekly", 14: "biweekly", 28: "monthly", 29: "monthly", 30: "monthly", 31: "monthly",
          90: "quarterly", 365: "yearly", 366: "yearly"}


def interval_type(k: int) -> str:
    return _TYPES.get(k, f"every {k} days")


def merchant_amount_groups(txns: DataFrame, min_count: int = RECURRING_MIN_OCCURRENCES) -> DataFrame:
    """(merchant, amount) groups with at least ``min_count`` rows: count, first and last date.

    Member rows stay in the ledger (join back on the key) instead of being collected
    into one list per group.
    """
    return (txns.groupBy("merchant", "amount")
            .agg(F.count(F.lit(1)).alias("count"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date"))
            .filter(F.col("count") >= min_count))


def gap_stats(txns: DataFrame) -> DataFrame:
    """Per (merchant, amount): n rows, m = n - 1 gaps, S and Q of the day gaps."""
    days = txns.groupBy("merchant", "amount", "date").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("merchant", "amount").orderBy("date")
    gaps = days.withColumn("gap", F.datediff("date", F.lag("date").over(w)).cast("long"))
    return (gaps.groupBy("merchant", "amount")
            .agg(F.sum("c").alias("n"),
                 F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("S"),
                 F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).cast("long").alias("Q"))
            .withColumn("m", F.col("n") - 1))


def recurring_detect(txns: DataFrame, intervals=RECURRING_INTERVALS, tol: int = RECURRING_TOLERANCE_DAYS,
                     long_tol: int = RECURRING_LONG_TOLERANCE_DAYS,
                     min_count: int = RECURRING_MIN_OCCURRENCES) -> DataFrame:
    """Recurring groups: merchant, amount, count, interval (half-even rounded mean gap),
    interval type and a stable group id (hash of the key)."""
    g = gap_stats(txns).filter(F.col("n") >= min_count)
    # exact integer arithmetic without LONG overflow for very large groups
    S, Q, m = (F.col(c).cast("decimal(38,0)") for c in ("S", "Q", "m"))
    matched = None
    for k in intervals:
        t = long_tol if k >= 365 else tol
        ok = (F.abs(S - k * m) <= t * m) & ((m == 1) | (m * Q - S * S <= t * t * m * (m - 1)))
        matched = F.when(ok, F.lit(k)) if matched is None else matched.when(ok, F.lit(k))
    types = F.create_map(*[x for k in intervals for x in (F.lit(k), F.lit(interval_type(k)))])
    return (g.withColumn("known", matched).filter(F.col("known").isNotNull())
            .select("merchant", "amount", F.col("n").alias("count"),
                    F.bround(F.col("S") / F.col("m"), 0).cast("long").alias("interval_days"),
                    F.element_at(types, F.col("known")).alias("interval_type"),
                    F.xxhash64("merchant", "amount").alias("group_id")))


def recurring_mark(txns: DataFrame, groups: DataFrame) -> DataFrame:
    """Flag every row of a recurring group and attach the group id (join on the key)."""
    g = groups.select("merchant", "amount", F.col("group_id").alias("_gid"))
    return (txns.join(g, ["merchant", "amount"], "left")
            .withColumn("is_recurring", F.col("is_recurring") | F.col("_gid").isNotNull())
            .withColumn("recurring_group_id", F.coalesce("_gid", "recurring_group_id"))
            .drop("_gid"))


def recurring_by_merchant(txns: DataFrame) -> DataFrame:
    """Recurring rows grouped by merchant: amount of the earliest row, count, first/last date."""
    r = txns.filter(F.col("is_recurring"))
    return r.groupBy("merchant").agg(
        F.min_by("amount", F.struct("date", "id")).alias("amount"),
        F.count(F.lit(1)).alias("count"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
