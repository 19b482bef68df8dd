"""Projections, filters, lookups and listings over the ledger and its dimensions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contains_ci(col, needle: str):
    """Case-insensitive literal substring test (no LIKE wildcards)."""
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(needle.lower().strip()))


def txn_filter(txns: DataFrame, categories: DataFrame, category: str | None = None,
               search: str | None = None) -> DataFrame:
    """Search (merchant or description substring) and exact category-name filter."""
    df = txns
    if search:
        df = df.filter(contains_ci(F.col("merchant"), search) | contains_ci(F.col("description"), search))
    if category:
        ids = categories.filter(F.col("name") == category).select(F.col("id").alias("category_id"))
        df = df.join(ids, "category_id", "left_semi")
    return df


def txn_list(txns: DataFrame, categories: DataFrame, category: str | None = None,
             search: str | None = None, sort_by: str = "date", desc: bool = True,
             limit: int = 50, offset: int = 0):
    """One page of the filtered ledger plus the total count before paging.

    Returns ``(page, total)`` where ``total`` is a one-row DataFrame; the page is a
    TakeOrderedAndProject (top ``offset+limit``), never a full sort to one task.
    """
    df = txn_filter(txns, categories, category, search)
    key = {"date": F.col("date"), "amount": F.col("amount"),
           "merchant": F.lower(F.col("merchant"))}[sort_by]
    order = [key.desc() if desc else key.asc(), F.col("id").asc()]
    page = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page, total


#: Ids in a block of the page index' second step.
PAGE_BLOCK = 1 << 16


def _located(rows: DataFrame, key, desc: bool, offset: int, limit: int):
    """(the rows of the keys that the page's rows have, the rows of the page's first key that come before it, keys
    left): one count a key, of which the driver holds one number each."""
    counts = sorted(((r[0], r[1]) for r in rows.groupBy(key.alias("k")).count().collect()), key=lambda c: (c[0] is not None, c[0]) if c[0] is not None else (False, 0), reverse=desc)
    before, wanted, start = 0, [], 0
    for k, n in counts:
        if before + n > offset and before < offset + limit:
            start = start if wanted else before
            wanted.append(k)
        before += n
    known = [k for k in wanted if k is not None]
    here = key.isin(known) if known else F.lit(False)
    return rows.where(here | key.isNull() if None in wanted else here), offset - start, wanted


def txn_page(txns: DataFrame, categories: DataFrame, offset: int, limit: int = 50, desc: bool = True,
             category: str | None = None, search: str | None = None) -> DataFrame:
    """A page by date (then id) at any depth, as ``txn_list`` gives it, without sorting what comes before.

    Counts per date tell which dates the page's rows have; if that is a single one, counts per block of ids
    tell which block. Only those rows are sorted. The driver holds a count for each date, then for each
    ``PAGE_BLOCK`` ids of one date."""
    rows, rest, dates = _located(txn_filter(txns, categories, category, search), F.col("date"), desc, offset, limit)
    if len(dates) == 1:
        rows, rest, _ = _located(rows, F.floor(F.col("id") / PAGE_BLOCK), False, rest, limit)
    order = [F.col("date").desc() if desc else F.col("date").asc(), F.col("id").asc()]
    return rows.orderBy(*order).offset(rest).limit(limit)


def txn_by_keys(txns: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Bulk exact-match filter: rows whose ``on`` value appears in ``keys``."""
    return txns.join(keys.select(on).distinct(), on, "left_semi")


def txn_by_account_recent(txns: DataFrame, limit: int = 100) -> DataFrame:
    """Newest ``limit`` transactions of every account (per-group top-k, WindowGroupLimit)."""
    w = Window.partitionBy("account_id").orderBy(F.desc("date"), F.asc("id"))
    return (txns.filter(F.col("account_id").isNotNull())
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def txn_uncategorized(txns: DataFrame, exclude_split: bool = False) -> DataFrame:
    df = txns.filter(F.col("category_id").isNull())
    return df.filter(~F.col("is_split")) if exclude_split else df


def txn_anomalies(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("is_anomaly"))


def merchant_like(txns: DataFrame, merchant: str, limit: int = 50) -> DataFrame:
    """LOWER(merchant) LIKE '%needle%' (``%``/``_`` in the needle act as wildcards, a backslash is a plain
    character), newest first."""
    pattern = "%" + merchant.lower().replace("\\", "\\\\") + "%"
    return (txns.filter(F.lower("merchant").like(pattern))
            .orderBy(F.desc("date"), F.asc("id")).limit(limit))


def merchants_distinct(txns: DataFrame) -> DataFrame:
    return txns.select("merchant").distinct()


def lookup_by_keys(df: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    """Point lookups in bulk: a semi-join against a key frame."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("is_active"))


def active_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Active rules joined to their category (orphans dropped), priority desc, created_at."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return (rules.filter(F.col("is_active")).join(cats, "category_id")
            .orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")))


def active_bills(bills: DataFrame, categories: DataFrame, accounts: DataFrame) -> DataFrame:
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    accs = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return (bills.filter(F.col("is_active"))
            .join(cats, "category_id", "left").join(accs, "account_id", "left")
            .orderBy(F.asc_nulls_last("next_due_date"), F.asc("name"), F.asc("id")))


def category_budgets(categories: DataFrame) -> DataFrame:
    return categories.filter(F.col("budget_amount") > 0).orderBy(F.desc("budget_amount"), F.asc("id"))


def latest_log(log: DataFrame, order=("created_at", "id")) -> DataFrame:
    """Latest categorisation log row per transaction (newest ``created_at``, then highest id).

    A ``max(struct(order..., row))`` aggregate: combined map-side, so a transaction with a
    very long log is never gathered into one task.
    """
    rest = [c for c in log.columns if c not in ("transaction_id", *order)]
    latest = log.groupBy("transaction_id").agg(F.max(F.struct(*order, *rest)).alias("_l"))
    return latest.select("transaction_id", *[F.col(f"_l.{c}").alias(c) for c in (*order, *rest)])


def settings_typed(settings: DataFrame) -> DataFrame:
    """Typed key/value settings: a value containing '.' is a float, else an int when it
    parses as one, else text. Returns (key, value_text, value_num, value_type)."""
    v = F.col("value")
    as_num = F.when(F.contains(v, F.lit(".")), F.expr("try_cast(value AS DOUBLE)")) \
        .otherwise(F.expr("try_cast(try_cast(value AS BIGINT) AS DOUBLE)"))
    return settings.select("key", v.alias("value_text"), as_num.alias("value_num"),
                           F.when(F.contains(v, F.lit(".")), F.lit("float"))
                           .when(F.expr("try_cast(value AS BIGINT)").isNotNull(), F.lit("int"))
                           .otherwise(F.lit("text")).alias("value_type"))


def setting_value(settings: DataFrame, key: str, default: float) -> DataFrame:
    """One-row, one-column frame holding a numeric setting (default when absent/non-numeric)."""
    typed = settings_typed(settings)
    return typed.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("value_num"))),
                                F.lit(float(default))).alias(key))
