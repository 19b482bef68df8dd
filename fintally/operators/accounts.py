"""Account balances (as of a date), per-account status, available credit, net worth.

The ledger is first reduced to one row per (account, day) with a partial aggregate, so the
join with the account dimension and the date-window conditions run on a frame whose size
is bounded by accounts x days, not by transactions, and a hot account is pre-combined
map-side.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.dates import as_date, month_key
from fintally.schema import MONEY


def _daily(txns: DataFrame) -> DataFrame:
    return (txns.filter(F.col("account_id").isNotNull())
            .groupBy("account_id", "date")
            .agg(F.sum("amount").alias("d_sum"), F.count(F.lit(1)).alias("d_n"),
                 F.sum(F.when(F.col("amount") < 0, F.col("amount"))).alias("d_exp"),
                 F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("d_inc")))


def _signed(balance_sum, account_type="account_type", initial="initial_balance"):
    """initial + sum for asset accounts, initial - sum for credit (amount owed)."""
    s = F.coalesce(balance_sum, M.zero())
    return F.when(F.col(account_type) == "credit", F.col(initial) - s).otherwise(F.col(initial) + s)


def account_balance_asof(accounts: DataFrame, txns: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """Balance of every account as of ``as_of`` (inclusive); ``None`` means no upper bound.

    Only transactions after ``balance_as_of_date`` count; asking for a date before it gives
    NULL. Credit accounts report the amount owed (initial - sum).
    """
    daily = _daily(txns)
    bdate = F.col("balance_as_of_date")
    in_window = bdate.isNull() | (F.col("date") > bdate)
    if as_of is not None:
        in_window = in_window & (F.col("date") <= as_date(as_of))
    sums = (daily.join(accounts.select(F.col("id").alias("account_id"), "balance_as_of_date"),
                       "account_id")
            .filter(in_window)
            .groupBy("account_id").agg(F.sum("d_sum").alias("txn_sum")))
    bal = _signed(F.col("txn_sum"))
    if as_of is not None:
        bal = F.when(bdate.isNotNull() & (as_date(as_of) < bdate), F.lit(None).cast(MONEY)).otherwise(bal)
    return (accounts.join(sums, accounts.id == sums.account_id, "left")
            .select("id", "name", "account_type", M.out(bal).alias("balance")))


def account_balances_at(accounts: DataFrame, txns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The balance of every wanted (account_id, as_of), inclusive, as ``account_balance_asof`` gives it for one date.

    An as-of join without a range join: postings, summed by day first, and wanted dates are put in one order per
    account and month, where a running sum meets each date behind the postings of its day; the months' sums are
    carried over in a second, short running sum per account. So an account's postings are never gathered
    in one task, however many it has. Repeated wanted rows are one; unknown accounts and null dates have no row."""
    acc = accounts.select(F.col("id").alias("account_id"), "account_type", "initial_balance", "balance_as_of_date")
    posted = (_daily(txns).join(acc.select("account_id", "balance_as_of_date"), "account_id")
              .filter(F.col("balance_as_of_date").isNull() | (F.col("date") > F.col("balance_as_of_date")))
              .select("account_id", "date", F.lit(0).alias("asked"), F.col("d_sum").alias("amount")))
    asked = (wanted.filter(F.col("as_of").isNotNull()).select("account_id", F.col("as_of").alias("date")).distinct()
             .select("account_id", "date", F.lit(1).alias("asked"), F.lit(None).cast(MONEY).alias("amount")))
    both = posted.unionByName(asked).withColumn("month", F.trunc("date", "month"))
    inside = Window.partitionBy("account_id", "month").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("account_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = both.groupBy("account_id", "month").agg(F.sum("amount").alias("m_sum")).select("account_id", "month", F.sum("m_sum").over(earlier).alias("carried"))
    at = (both.withColumn("run", F.sum("amount").over(inside)).filter(F.col("asked") == 1)
          .join(months, ["account_id", "month"]).join(acc, "account_id"))
    total = F.coalesce("carried", M.zero()) + F.coalesce("run", M.zero())
    bal = F.when(F.col("date") < F.col("balance_as_of_date"), F.lit(None).cast(MONEY)).otherwise(_signed(total))
    return at.select("account_id", F.col("date").alias("as_of"), M.out(bal).alias("balance"))


def account_status(accounts: DataFrame, txns: DataFrame, as_of, active_only: bool = True) -> DataFrame:
    """Per account: current balance, transaction count, spending and income in as_of's month,
    and for credit accounts the limit and available credit; plus the balance label."""
    acc = accounts.filter(F.col("is_active")) if active_only else accounts
    daily = _daily(txns)
    ym = month_key(as_date(as_of))
    bdate = F.col("balance_as_of_date")
    joined = daily.join(acc.select(F.col("id").alias("account_id"), "balance_as_of_date"), "account_id")
    agg = joined.groupBy("account_id").agg(
        F.sum(F.when(bdate.isNull() | (F.col("date") > bdate), F.col("d_sum"))).alias("txn_sum"),
        F.sum("d_n").alias("transaction_count"),
        F.sum(F.when(month_key(F.col("date")) == ym, F.col("d_exp"))).alias("m_exp"),
        F.sum(F.when(month_key(F.col("date")) == ym, F.col("d_inc"))).alias("m_inc"))
    is_credit = F.col("account_type") == "credit"
    bal = _signed(F.col("txn_sum"))
    avail = F.greatest(M.zero(), F.col("initial_balance") - bal)
    return (acc.join(agg, acc.id == agg.account_id, "left")
            .select("id", "name", "account_type",
                    M.out(bal).alias("balance"),
                    F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
                    M.out(F.abs(F.coalesce("m_exp", M.zero()))).alias("spending_this_month"),
                    M.out(F.coalesce("m_inc", M.zero())).alias("income_this_month"),
                    M.out(F.when(is_credit, F.col("initial_balance"))).alias("credit_limit"),
                    M.out(F.when(is_credit, avail)).alias("available_credit"),
                    F.when(is_credit, F.lit("Owed")).otherwise(F.lit("Balance")).alias("balance_label")))


def net_worth(status: DataFrame) -> DataFrame:
    """Assets minus credit debt, the plain sum of balances, and total available credit.

    Balances are cents-exact, so they are summed as DECIMAL (order-independent) and only
    the totals are returned as DOUBLE.
    """
    is_credit = F.col("account_type") == "credit"
    b = F.coalesce(F.col("balance").cast(MONEY), M.zero())
    avail = F.coalesce(F.col("available_credit").cast(MONEY), M.zero())
    return status.agg(
        M.out(F.sum(F.when(~is_credit, b).otherwise(M.zero()))
              - F.sum(F.when(is_credit, b).otherwise(M.zero()))).alias("net_worth"),
        M.out(F.sum(b)).alias("total_balance"),
        M.out(F.sum(F.when(is_credit, avail).otherwise(M.zero()))).alias("total_available_credit"))
