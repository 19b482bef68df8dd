"""Money helpers. Amounts stay DECIMAL(18,2) inside; DOUBLE only at the output edge."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fintally.schema import MONEY


def out(c) -> Column:
    """Cast an exact money value to DOUBLE for output."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def expense_abs(amount="amount") -> Column:
    """|amount| of an expense row, else 0."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.when(a < 0, -a).otherwise(F.lit(0).cast(MONEY))


def income(amount="amount") -> Column:
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.when(a > 0, a).otherwise(F.lit(0).cast(MONEY))


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def round_double(c, n: int = 2) -> Column:
    """Round a DOUBLE by scaling, rounding the scaled double, and scaling back.

    Spark's ``round`` on a DOUBLE rounds its shortest decimal text half-up, so 323304.345
    (stored as 323304.34499999997...) would become .35; rounding the scaled product follows
    the stored binary value instead, like Python's ``round`` on a float.
    """
    x = F.col(c) if isinstance(c, str) else c
    k = float(10 ** n)
    return F.round(x * k, 0) / k
