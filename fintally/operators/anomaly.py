"""Anomaly detection: per-category IQR bounds and high first-time merchants.

Category statistics use exact index quartiles (sorted[n//4], sorted[3n//4] on |amount|),
found by radix select (``stats.kth_smallest``) so a category holding a third of the ledger
is never sorted in one task. The global median for the new-merchant rule uses the same
operator with no grouping key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.operators.stats import kth_smallest
from fintally.schema import ANOMALY_IQR_MULTIPLIER, ANOMALY_MEDIAN_MULTIPLIER, MONEY


def _cents(col="amount"):
    return (F.abs(F.col(col)) * 100).cast("long")


def _categorised(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("category_id").isNotNull() & (F.col("category_id") != 0))


def _category_base(txns: DataFrame) -> DataFrame:
    return _categorised(txns).groupBy("category_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.abs("amount")).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.coalesce(F.stddev_samp(F.abs("amount").cast("double")), F.lit(0.0)).alias("std"))


def order_statistics(txns: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Category quartile ranks and the global median ranks resolved in one radix select.

    Returns (kind, category_id, tag, kth cents): kind 1 rows are per category (tags q1, q3),
    the kind 0 row group is the whole ledger (tags lo, hi = the two middle positions).
    """
    base = base if base is not None else _category_base(txns)
    n_all = txns.agg(F.count(F.lit(1)).alias("n"))
    targets = (base.select(F.lit(1).alias("kind"), "category_id", F.lit("q1").alias("tag"),
                           F.floor(F.col("n") / 4).alias("rank"))
               .unionByName(base.select(F.lit(1).alias("kind"), "category_id", F.lit("q3").alias("tag"),
                                        F.floor(F.col("n") * 3 / 4).alias("rank")))
               .unionByName(n_all.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("category_id"),
                                         F.lit("lo").alias("tag"), F.floor((F.col("n") - 1) / 2).alias("rank")))
               .unionByName(n_all.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("category_id"),
                                         F.lit("hi").alias("tag"), F.floor(F.col("n") / 2).alias("rank"))))
    vals = (_categorised(txns).select(F.lit(1).alias("kind"), "category_id", _cents().alias("c"))
            .unionByName(txns.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("category_id"),
                                     _cents().alias("c"))))
    return kth_smallest(vals, ["kind", "category_id"], "c", targets)


def category_stats(txns: DataFrame, _order: DataFrame | None = None) -> DataFrame:
    """Per category: n, mean and sample stdev of |amount| (stdev 0 when n = 1), and the index
    quartiles q1 = sorted[n//4], q3 = sorted[3n//4]."""
    base = _category_base(txns)
    if _order is None:
        targets = (base.select("category_id", F.lit("q1").alias("tag"), F.floor(F.col("n") / 4).alias("rank"))
                   .unionByName(base.select("category_id", F.lit("q3").alias("tag"),
                                            F.floor(F.col("n") * 3 / 4).alias("rank"))))
        q = kth_smallest(_categorised(txns).select("category_id", _cents().alias("c")), ["category_id"], "c", targets)
    else:
        q = _order.filter(F.col("kind") == 1).select("category_id", "tag", "kth")
    qs = q.groupBy("category_id").agg(
        (F.max(F.when(F.col("tag") == "q1", F.col("kth"))).cast(MONEY) / 100).cast(MONEY).alias("q1"),
        (F.max(F.when(F.col("tag") == "q3", F.col("kth"))).cast(MONEY) / 100).cast(MONEY).alias("q3"))
    return (base.join(qs, "category_id")
            .withColumn("std", F.when(F.col("n") > 1, F.col("std")).otherwise(F.lit(0.0))))


def iqr_bounds(stats: DataFrame, k: float = ANOMALY_IQR_MULTIPLIER) -> DataFrame:
    """Lower/upper bounds per category; categories with q1 = q3 = 0 get none.

    IQR = 0 gives upper = q3 * (1 + k) and lower = q1 * (1 - k) (negative, so never used).
    """
    kk = F.lit(str(k)).cast("decimal(10,4)")
    iqr = F.col("q3") - F.col("q1")
    lower = F.when(iqr == 0, F.col("q1") * (1 - kk)).otherwise(F.col("q1") - kk * iqr)
    upper = F.when(iqr == 0, F.col("q3") * (1 + kk)).otherwise(F.col("q3") + kk * iqr)
    return (stats.filter((F.col("q1") > 0) | (F.col("q3") > 0))
            .select("category_id", "q1", "q3", lower.alias("lower_bound"), upper.alias("upper_bound")))


def anomaly_iqr(txns: DataFrame, k: float = ANOMALY_IQR_MULTIPLIER, _order: DataFrame | None = None) -> DataFrame:
    """Categorised rows with |amount| above the upper bound, or below a positive lower bound."""
    b = iqr_bounds(category_stats(txns, _order), k)
    a = F.abs("amount")
    return (_categorised(txns).join(b, "category_id")
            .withColumn("above", a > F.col("upper_bound"))
            .withColumn("below", ~(a > F.col("upper_bound")) & (a < F.col("lower_bound"))
                        & (F.col("lower_bound") > 0))
            .filter(F.col("above") | F.col("below")))


def global_median_abs(txns: DataFrame, _order: DataFrame | None = None) -> DataFrame:
    """One row with the exact median of |amount| (mean of the two middle values when even)."""
    if _order is None:
        n = txns.agg(F.count(F.lit(1)).alias("n"))
        targets = (n.select(F.lit("lo").alias("tag"), F.floor((F.col("n") - 1) / 2).alias("rank"))
                   .unionByName(n.select(F.lit("hi").alias("tag"), F.floor(F.col("n") / 2).alias("rank"))))
        q = kth_smallest(txns.select(_cents().alias("c")), [], "c", targets)
    else:
        q = _order.filter(F.col("kind") == 0).select("tag", "kth")
    return q.agg(((F.sum("kth") / 2).cast("decimal(20,3)") / 100).cast("decimal(20,5)").alias("median"))


def anomaly_new_merchant(txns: DataFrame, k: float = ANOMALY_MEDIAN_MULTIPLIER,
                         _order: DataFrame | None = None) -> DataFrame:
    """Rows of merchants seen exactly once whose |amount| exceeds k x the global median
    (and the threshold is positive). Merchant counts are a partial aggregate, then a semi-join."""
    once = txns.groupBy("merchant").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("merchant")
    threshold = global_median_abs(txns, _order).select((F.col("median") * k).alias("t")).scalar()
    return (txns.join(once, "merchant", "left_semi")
            .withColumn("threshold", threshold)
            .filter((F.abs("amount") > F.col("threshold")) & (F.col("threshold") > 0)))


def anomaly_report(txns: DataFrame) -> DataFrame:
    """One row per flagged transaction with both checks and a '; '-joined reason text.

    Quartiles and the median come from one shared radix select (``order_statistics``)."""
    order = order_statistics(txns)
    iqr = anomaly_iqr(txns, _order=order).select("id", "above", "below", "lower_bound", "upper_bound")
    nm = anomaly_new_merchant(txns, _order=order).select("id", F.lit(True).alias("new_merchant"), "threshold")
    flagged = iqr.join(nm, "id", "full_outer")
    a = F.abs("amount")
    # two-decimal text of an exact value (DECIMAL keeps '%.2f' free of binary noise)
    money = lambda c: F.round(c.cast("decimal(30,6)"), 2).cast("decimal(30,2)").cast("string")
    reason = F.concat_ws(
        "; ",
        F.when(F.col("above"), F.concat(F.lit("Amount $"), money(a), F.lit(" exceeds category normal range (max $"),
                                        money(F.col("upper_bound")), F.lit(")"))),
        F.when(F.col("below"), F.concat(F.lit("Amount $"), money(a), F.lit(" below category normal range (min $"),
                                        money(F.col("lower_bound")), F.lit(")"))),
        F.when(F.col("new_merchant"), F.concat(F.lit("New merchant with high amount $"), money(a),
                                               F.lit(" (threshold $"), money(F.col("threshold")), F.lit(")"))))
    return (txns.join(flagged, "id")
            .select(F.col("id").alias("transaction_id"), "merchant", "amount",
                    F.coalesce("above", F.lit(False)).alias("above"),
                    F.coalesce("below", F.lit(False)).alias("below"),
                    F.coalesce("new_merchant", F.lit(False)).alias("new_merchant"),
                    "lower_bound", "upper_bound", "threshold", reason.alias("reason")))


def mark_anomalies(txns: DataFrame, report: DataFrame) -> DataFrame:
    """Set is_anomaly for reported rows (the flag is only ever switched on)."""
    ids = report.select(F.col("transaction_id").alias("id")).distinct().withColumn("_flag", F.lit(True))
    return (txns.join(ids, "id", "left")
            .withColumn("is_anomaly", F.col("is_anomaly") | F.coalesce("_flag", F.lit(False)))
            .drop("_flag"))
