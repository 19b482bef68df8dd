"""Frequency arithmetic as Column expressions: monthly equivalents and next due dates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fintally.functions.dates import as_date
from fintally.schema import BILL_STEP_DAYS, BILL_STEP_MONTHS, MONEY

# Exact decimal scale used for monthly equivalents before the final rounding.
_EQ = "decimal(30,6)"


def bill_monthly_equivalent(amount, frequency) -> Column:
    """|amount| as a monthly amount by bill frequency (unknown frequency counts as monthly).

    Kept in DECIMAL (scale 6) so sums are exact and order-independent; daily x30,
    weekly x4.33, biweekly x2.17, quarterly /3, yearly and annually /12.
    """
    a = F.abs(F.col(amount) if isinstance(amount, str) else amount).cast(MONEY)
    f = F.col(frequency) if isinstance(frequency, str) else frequency
    return (F.when(f == "daily", a * 30)
            .when(f == "weekly", a * F.lit(4.33).cast("decimal(3,2)"))
            .when(f == "biweekly", a * F.lit(2.17).cast("decimal(3,2)"))
            .when(f == "quarterly", a / 3)
            .when(f.isin("yearly", "annually"), a / 12)
            .otherwise(a)).cast(_EQ)


def income_monthly_equivalent(amount, frequency) -> Column:
    """Income as a monthly amount: weekly x4.33, biweekly x2.17, semimonthly x2, yearly /12."""
    a = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    f = F.col(frequency) if isinstance(frequency, str) else frequency
    return (F.when(f == "weekly", a * 4.33).when(f == "biweekly", a * 2.17)
            .when(f == "semimonthly", a * 2).when(f == "yearly", a / 12).otherwise(a))


def next_due_date(start, frequency, as_of) -> Column:
    """First date of the schedule ``start, start+step, ...`` that is after ``as_of``.

    ``start`` itself when it is already after ``as_of``. Day-based steps use a closed form.
    Month-based steps are applied one after another, because a clamped month end sticks
    (01-31 -> 02-29 -> 03-29); the number of steps is bounded by the span in months, so the
    per-row ``aggregate`` is small. Unknown frequencies step monthly.
    """
    s = F.col(start) if isinstance(start, str) else start
    f = F.lower(F.col(frequency) if isinstance(frequency, str) else frequency)
    a = as_date(as_of)
    gap = F.datediff(a, s)  # >= 0 when start is not after as_of

    def by_days(step: int) -> Column:
        return F.date_add(s, ((F.floor(gap / step) + 1) * step).cast("int"))

    def by_months(m: int) -> Column:
        n = (F.floor(F.months_between(a, s) / m) + 2).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), s,
                           lambda acc, _i: F.when(acc <= a, F.add_months(acc, m)).otherwise(acc))

    expr = None
    for name, step in BILL_STEP_DAYS.items():
        expr = (F.when(f == name, by_days(step)) if expr is None else expr.when(f == name, by_days(step)))
    for name, m in BILL_STEP_MONTHS.items():
        if m == 1:
            continue
        expr = expr.when(f == name, by_months(m))
    expr = expr.otherwise(by_months(1))
    return F.when(s.isNull(), F.lit(None).cast("date")).when(s > a, s).otherwise(expr)
