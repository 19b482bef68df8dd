"""Recurring detection on the reference's literal fixtures."""
from fintally.operators import recurring as RC
from tests.helpers import ledger


def _detect(spark, rows):
    return {(r["merchant"]): r for r in RC.recurring_detect(ledger(spark, rows)).collect()}


def test_monthly(spark):
    rows = [(1, "2024-01-15", -15.99, "NETFLIX"), (2, "2024-02-15", -15.99, "NETFLIX"),
            (3, "2024-03-15", -15.99, "NETFLIX")]
    r = _detect(spark, rows)["NETFLIX"]
    assert 28 <= r["interval_days"] <= 31 and r["interval_type"] == "monthly" and r["count"] == 3


def test_weekly(spark):
    rows = [(i, f"2024-01-{1 + 7 * i:02d}", -100.00, "GYM") for i in range(4)]
    r = _detect(spark, rows)["GYM"]
    assert r["interval_days"] == 7 and r["interval_type"] == "weekly"


def test_yearly(spark):
    rows = [(1, "2022-03-01", -12.00, "DOMAIN"), (2, "2023-03-01", -12.00, "DOMAIN"),
            (3, "2024-03-01", -12.00, "DOMAIN")]
    r = _detect(spark, rows)["DOMAIN"]
    assert r["interval_days"] in (365, 366) and r["interval_type"] == "yearly"


def test_one_off_not_recurring(spark):
    rows = [(1, "2024-01-15", -50.00, "SHOP A"), (2, "2024-02-20", -75.00, "SHOP B")]
    assert _detect(spark, rows) == {}


def test_jitter(spark):
    rows = [(1, "2024-01-01", -1500.00, "RENT"), (2, "2024-02-02", -1500.00, "RENT"),
            (3, "2024-03-01", -1500.00, "RENT"), (4, "2024-04-03", -1500.00, "RENT")]
    assert "RENT" in _detect(spark, rows)


def test_same_day_copies_count_as_zero_gaps(spark):
    # three rows on two dates: gaps 0 and 30 -> mean 15, stdev 21.2 -> not recurring
    rows = [(1, "2024-01-01", -5.00, "X"), (2, "2024-01-01", -5.00, "X"), (3, "2024-01-31", -5.00, "X")]
    assert _detect(spark, rows) == {}
    g = RC.gap_stats(ledger(spark, rows)).collect()[0]
    assert (g["n"], g["m"], g["S"], g["Q"]) == (3, 2, 30, 900)


def test_mark_all_rows(spark):
    rows = [(1, "2024-01-15", -15.99, "NETFLIX"), (2, "2024-02-15", -15.99, "NETFLIX"),
            (3, "2024-03-15", -15.99, "NETFLIX"), (4, "2024-03-20", -3.00, "COFFEE")]
    led = ledger(spark, rows)
    marked = RC.recurring_mark(led, RC.recurring_detect(led))
    flags = {r["id"]: r["is_recurring"] for r in marked.collect()}
    assert flags == {1: True, 2: True, 3: True, 4: False}


def test_empty(spark):
    assert RC.recurring_detect(ledger(spark, [])).count() == 0
