"""Ledger aggregations: totals, monthly/daily/weekday series, category and merchant rollups.

All aggregations are plain ``groupBy``/``agg`` so Spark does map-side partial aggregation:
a hot merchant or category is combined inside each task before the shuffle, so skew in
the grouping key does not concentrate raw rows in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.dates import as_date, month_key, months_back


def summary_totals(txns: DataFrame) -> DataFrame:
    """One row: count, income, expenses, net, recurring count/sum, anomalies, uncategorised."""
    inc = F.sum(M.income())
    exp = F.sum(M.expense_abs())
    return txns.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        M.out(F.coalesce(inc, M.zero())).alias("total_income"),
        M.out(F.coalesce(exp, M.zero())).alias("total_expenses"),
        M.out(F.coalesce(inc, M.zero()) - F.coalesce(exp, M.zero())).alias("net"),
        F.count_if(F.col("is_recurring")).alias("recurring_transactions"),
        M.out(F.coalesce(F.sum(F.when(F.col("is_recurring"), F.abs("amount"))), M.zero()))
        .alias("estimated_monthly_recurring"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"),
        F.count_if(F.col("category_id").isNull() | (F.col("category_id") == 0)).alias("uncategorized"),
    )


def summary_by_category(txns: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category with at least one transaction: count, sum |amount|, mean |amount|."""
    agg = (txns.filter(F.col("category_id").isNotNull())
           .groupBy("category_id")
           .agg(F.count(F.lit(1)).alias("count"), F.sum(F.abs("amount")).alias("total")))
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (agg.join(cats, "category_id")
            .select("category_id", "category", "count", M.out("total").alias("total"),
                    (F.col("total").cast("double") / F.col("count")).alias("average")))


def monthly_totals(txns: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Income and expenses per 'yyyy-MM' from ``months`` months before ``as_of`` onwards."""
    return (txns.filter(F.col("date") >= months_back(as_of, months))
            .groupBy(month_key(F.col("date")).alias("month"))
            .agg(M.out(F.sum(M.income())).alias("income"),
                 M.out(F.sum(M.expense_abs())).alias("expenses")))


def category_totals(txns: DataFrame, categories: DataFrame, year: int | None = None,
                    month: int | None = None) -> DataFrame:
    """Every category with |expense| total and count (zero rows kept), for a month or all time."""
    exp = txns.filter(F.col("amount") < 0)
    if year and month:
        exp = exp.filter(month_key(F.col("date")) == f"{year:04d}-{month:02d}")
    agg = exp.groupBy("category_id").agg(F.sum(F.abs("amount")).alias("total"),
                                         F.count(F.lit(1)).alias("count"))
    return (categories.select("id", "name")
            .join(agg, categories.id == agg.category_id, "left")
            .select("id", "name", M.out(F.coalesce("total", M.zero())).alias("total"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def category_totals_with_splits(txns: DataFrame, splits: DataFrame, categories: DataFrame,
                                year: int | None = None, month: int | None = None) -> DataFrame:
    """Category spending where split parents are replaced by their split lines.

    Non-split expenses contribute |amount| to their category; each split line of an
    expense parent (split flag not required) contributes its stored amount to its category.
    """
    exp = txns.filter(F.col("amount") < 0)
    if year and month:
        exp = exp.filter(month_key(F.col("date")) == f"{year:04d}-{month:02d}")
    plain = (exp.filter(~F.col("is_split"))
             .select("category_id", F.abs("amount").alias("amt"), F.col("id").alias("txn_id")))
    parents = exp.select(F.col("id").alias("transaction_id"))
    lines = (splits.join(parents, "transaction_id", "left_semi")
             .select("category_id", F.col("amount").alias("amt"),
                     F.col("transaction_id").alias("txn_id")))
    agg = (plain.unionByName(lines).groupBy("category_id")
           .agg(F.sum("amt").alias("total"), F.count(F.lit(1)).alias("count")))
    return (categories.select("id", "name")
            .join(agg, categories.id == agg.category_id, "left")
            .select("id", "name", M.out(F.coalesce("total", M.zero())).alias("total"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def daily_spending(txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    lo = F.date_sub(as_date(as_of), days)
    return (txns.filter((F.col("amount") < 0) & (F.col("date") >= lo))
            .groupBy("date").agg(M.out(F.sum(F.abs("amount"))).alias("total")))


def top_merchants(txns: DataFrame, as_of, limit: int = 10, days: int = 90) -> DataFrame:
    """Top ``limit`` merchants by |expense| in the last ``days`` days (ties by merchant)."""
    lo = F.date_sub(as_date(as_of), days)
    return (txns.filter((F.col("amount") < 0) & (F.col("date") >= lo))
            .groupBy("merchant")
            .agg(F.sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("total"), F.asc("merchant")).limit(limit)
            .select("merchant", M.out("total").alias("total"), "count"))


def top_merchants_net(txns: DataFrame, limit: int = 20) -> DataFrame:
    """All-time signed total per merchant, largest |total| first."""
    return (txns.groupBy("merchant")
            .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc(F.abs("total")), F.asc("merchant")).limit(limit)
            .select("merchant", M.out("total").alias("total"), "count"))


_DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def weekday_spending(txns: DataFrame) -> DataFrame:
    """Sun..Sat: mean and sum of |expense| (Spark's dayofweek counts Sunday as 1)."""
    day_num = (F.dayofweek("date") - 1).cast("long")
    names = F.array(*[F.lit(n) for n in _DAY_NAMES])
    return (txns.filter(F.col("amount") < 0)
            .groupBy(day_num.alias("day_num"))
            .agg(F.sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("n"))
            .select("day_num", F.element_at(names, (F.col("day_num") + 1).cast("int")).alias("day"),
                    (F.col("total").cast("double") / F.col("n")).alias("avg"),
                    M.out("total").alias("total")))


def category_trend(txns: DataFrame, as_of, category_id: int | None = None,
                   months: int = 6) -> DataFrame:
    """|expense| per (category, month) for the last ``months`` months; one category if given."""
    df = txns.filter((F.col("amount") < 0) & (F.col("date") >= months_back(as_of, months))
                     & F.col("category_id").isNotNull())
    if category_id is not None:
        df = df.filter(F.col("category_id") == category_id)
    return (df.groupBy("category_id", month_key(F.col("date")).alias("month"))
            .agg(M.out(F.sum(F.abs("amount"))).alias("total")))


def category_spending(txns: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """|expense| per category in a month (or all time)."""
    df = txns.filter((F.col("amount") < 0) & F.col("category_id").isNotNull())
    if year and month:
        df = df.filter(month_key(F.col("date")) == f"{year:04d}-{month:02d}")
    return df.groupBy("category_id").agg(M.out(F.sum(F.abs("amount"))).alias("spent"))


def category_status(txns: DataFrame, categories: DataFrame, year: int, month: int) -> DataFrame:
    """Per category: all-time transaction count, month spending, budget percent (capped at 100).

    One pass over the ledger replaces a count query and a spending query per category.
    """
    ym = f"{year:04d}-{month:02d}"
    in_month = (F.col("amount") < 0) & (month_key(F.col("date")) == ym)
    agg = (txns.filter(F.col("category_id").isNotNull())
           .groupBy("category_id")
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.sum(F.when(in_month, F.abs("amount"))).alias("spent")))
    spent = F.coalesce("spent", M.zero())
    budget = F.col("budget_amount")
    pct = F.when(budget > 0, F.least(F.lit(100.0), spent.cast("double") / budget.cast("double") * 100)) \
        .otherwise(F.lit(0.0))
    return (categories.join(agg, categories.id == agg.category_id, "left")
            .select("id", "name", M.out("budget_amount").alias("budget_amount"),
                    F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
                    M.out(spent).alias("spent"), pct.alias("budget_percent")))


def category_share(category_totals_df: DataFrame) -> DataFrame:
    """Share of each category's total in the grand total, in percent.

    The grand total is a global aggregate joined back as a scalar, not a window over one
    partition.
    """
    # totals are cents-exact: summing them as DECIMAL keeps the grand total order-independent
    grand = category_totals_df.select(F.sum(F.col("total").cast("decimal(20,2)")).cast("double")).scalar()
    return category_totals_df.select(
        "id", "name", "total",
        F.when(grand > 0, F.col("total") / grand * 100).otherwise(F.lit(0.0)).alias("share_pct"))
