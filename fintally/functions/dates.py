"""Date helpers as Column expressions (no Python per row)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value) -> Column:
    """Literal date or an existing Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(dt.date.fromisoformat(value))
    return F.lit(value)


def months_back(as_of, n: int) -> Column:
    """``date(as_of, '-n months')`` with day overflow carried into the next month.

    2024-03-31 minus one month gives 2024-03-02 (Feb 31 rolls over), unlike a clamping
    ``add_months``: step to the first of the month, move whole months, then add the days.
    """
    d = as_date(as_of)
    return F.date_add(F.add_months(F.trunc(d, "MM"), -n), F.dayofmonth(d) - 1)


def month_key(c) -> Column:
    """'yyyy-MM' bucket of a date."""
    return F.date_format(c, "yyyy-MM")


def month_bounds(month: str):
    """Half-open bounds [first day, first day of next month) of a 'YYYY-MM' string."""
    y, m = (int(x) for x in month.split("-"))
    start = dt.date(y, m, 1)
    end = dt.date(y + (m == 12), m % 12 + 1, 1)
    return start, end
