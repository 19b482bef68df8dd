"""Bills (recurring payments the user tracks): schedules, due lists, status, payments."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.dates import as_date, month_key
from fintally.functions.schedule import next_due_date


def _with_dims(bills: DataFrame, categories: DataFrame, accounts: DataFrame) -> DataFrame:
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    accs = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return bills.join(cats, "category_id", "left").join(accs, "account_id", "left")


def bills_upcoming(bills, categories, accounts, as_of, days: int = 7) -> DataFrame:
    """Active bills with a due date on or before as_of + days."""
    lim = F.date_add(as_date(as_of), days)
    b = bills.filter(F.col("is_active") & F.col("next_due_date").isNotNull() & (F.col("next_due_date") <= lim))
    return _with_dims(b, categories, accounts)


def bills_overdue(bills, categories, accounts, as_of) -> DataFrame:
    b = bills.filter(F.col("is_active") & F.col("next_due_date").isNotNull()
                     & (F.col("next_due_date") < as_date(as_of)))
    return _with_dims(b, categories, accounts)


def bills_due_soon(bills, categories, accounts, as_of_ts: dt.datetime, days: int = 7) -> DataFrame:
    """Due within ``days``: status overdue / due_soon (within 3 days) / upcoming and the
    fractional days until due, measured from the as-of timestamp.

    Computed from the calendar date and the time of day of ``as_of_ts`` (no time-zone
    conversion), so the result does not depend on the session time zone.
    """
    today = F.lit(as_of_ts.date())
    secs = as_of_ts.hour * 3600 + as_of_ts.minute * 60 + as_of_ts.second
    due = F.col("next_due_date")
    b = bills.filter(F.col("is_active") & due.isNotNull() & (due <= F.date_add(today, days)))
    status = (F.when(due < today, F.lit("overdue"))
              .when(due <= F.date_add(today, 3), F.lit("due_soon")).otherwise(F.lit("upcoming")))
    days_until = (F.datediff(due, today).cast("long") * 86400 - secs) / 86400.0
    return _with_dims(b, categories, accounts).select(
        "id", "name", "next_due_date", "category_name", "account_name",
        status.alias("status"), days_until.alias("days_until_due"))


def bill_status_label(due_soon: DataFrame) -> DataFrame:
    """Label of a due-soon row: 'Nd overdue', 'Due today' or 'Due in Nd'."""
    d = F.col("days_until_due")
    label = (F.when(F.col("status") == "overdue",
                    F.concat(F.abs(F.floor(d)).cast("string"), F.lit("d overdue")))
             .when(d <= 0, F.lit("Due today"))
             .otherwise(F.concat(F.lit("Due in "), F.ceil(d).cast("string"), F.lit("d"))))
    return due_soon.withColumn("label", label)


def subscription_status(bills: DataFrame, as_of) -> DataFrame:
    """Paused / Unknown / Nd overdue / Due today / Due in Nd by whole days to the due date."""
    diff = F.datediff(F.col("next_due_date"), as_date(as_of))
    label = (F.when(~F.col("is_active"), F.lit("Paused"))
             .when(F.col("next_due_date").isNull(), F.lit("Unknown"))
             .when(diff < 0, F.concat(F.abs(diff).cast("string"), F.lit("d overdue")))
             .when(diff == 0, F.lit("Due today"))
             .otherwise(F.concat(F.lit("Due in "), diff.cast("string"), F.lit("d"))))
    return bills.select("id", "name", label.alias("status_label"))


def bill_summary(bills: DataFrame, as_of) -> DataFrame:
    """Total and active counts, sum |amount| of active bills, overdue and next-7-day counts."""
    a = as_date(as_of)
    act = F.col("is_active")
    due = F.col("next_due_date")
    return bills.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(act).alias("active_count"),
        M.out(F.coalesce(F.sum(F.when(act, F.abs("amount"))), M.zero())).alias("monthly_total"),
        F.count_if(act & (due < a)).alias("overdue_count"),
        F.count_if(act & (due <= F.date_add(a, 7)) & (due >= a)).alias("upcoming_count"))


def bill_payment_summary(payments: DataFrame, year: int, month: int) -> DataFrame:
    ym = f"{year:04d}-{month:02d}"
    return (payments.filter(month_key(F.col("paid_date")) == ym)
            .agg(F.count(F.lit(1)).alias("payments_count"),
                 M.out(F.coalesce(F.sum("amount_paid"), M.zero())).alias("total_paid"),
                 F.countDistinct("recurring_id").alias("unique_bills")))


def payment_history(payments: DataFrame, bills: DataFrame, categories: DataFrame,
                    start=None, end=None, limit: int = 50, per_bill: bool = False) -> DataFrame:
    """Payments with bill and category names, newest first.

    ``per_bill=True`` keeps the newest ``limit`` payments of every bill (per-group top-k);
    otherwise the newest ``limit`` payments within the paid-date range.
    """
    p = payments
    if start is not None:
        p = p.filter(F.col("paid_date") >= as_date(start))
    if end is not None:
        p = p.filter(F.col("paid_date") <= as_date(end))
    b = bills.select(F.col("id").alias("recurring_id"), F.col("name").alias("bill_name"), "category_id")
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    j = p.join(b, "recurring_id", "left").join(cats, "category_id", "left")
    if per_bill:
        w = Window.partitionBy("recurring_id").orderBy(F.desc("paid_date"), F.desc("id"))
        return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return j.orderBy(F.desc("paid_date"), F.desc("id")).limit(limit)


def bill_mark_paid(bills: DataFrame, paid: DataFrame, as_of):
    """Apply a feed of payments ``paid`` (recurring_id, paid_date, amount_paid NULL allowed, id).

    Returns ``(bills', payments)``: a payment row per feed row (amount defaults to |bill
    amount|, due date = the bill's next due date or the paid date), and every paid bill's
    last_paid_date / next_due_date from its latest payment, the next due date being the
    schedule step after ``as_of`` counted from that paid date.
    """
    b = bills.select(F.col("id").alias("recurring_id"), F.col("amount").alias("bill_amount"),
                     F.col("next_due_date").alias("bill_due"))
    pay = (paid.join(b, "recurring_id")
           .select("id", "recurring_id",
                   F.coalesce(F.col("amount_paid"), F.abs("bill_amount")).alias("amount_paid"),
                   F.coalesce("bill_due", "paid_date").alias("due_date"), "paid_date"))
    latest = (paid.join(b.select("recurring_id"), "recurring_id", "left_semi")
              .groupBy("recurring_id")
              .agg(F.max_by("paid_date", F.struct("paid_date", "id")).alias("last_paid")))
    upd = bills.join(latest, bills.id == latest.recurring_id, "left")
    new_bills = upd.select(
        *[c for c in bills.columns if c not in ("last_paid_date", "next_due_date")],
        F.coalesce("last_paid", "last_paid_date").alias("last_paid_date"),
        F.when(F.col("last_paid").isNotNull(), next_due_date(F.col("last_paid"), F.col("frequency"), as_of))
        .otherwise(F.col("next_due_date")).alias("next_due_date"))
    return new_bills, pay


def bill_reschedule(bills: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Apply (id, frequency, start_date) changes; bills whose frequency or start changed get
    their next due date recomputed from the (new) start date. Of several changes of a bill and field
    the one with the highest ``seq`` (if the column is there), then the largest value, counts."""
    order = ["seq"] if "seq" in changes.columns else []
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c]
    c = changes.groupBy("id").agg(last("frequency").alias("new_freq"), last("start_date").alias("new_start"))
    j = bills.join(c, "id", "left")
    freq = F.coalesce("new_freq", "frequency")
    start = F.coalesce("new_start", "start_date")
    changed = F.col("new_freq").isNotNull() | F.col("new_start").isNotNull()
    return j.select(
        *[c for c in bills.columns if c not in ("frequency", "start_date", "next_due_date")],
        freq.alias("frequency"), start.alias("start_date"),
        F.when(changed, next_due_date(start, freq, as_of)).otherwise(F.col("next_due_date"))
        .alias("next_due_date"))
