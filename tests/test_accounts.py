"""Balances for many dates, and merchant patterns."""
import datetime as dt
import random

from pyspark.sql import functions as F

from fintally.operators import accounts as AC
from fintally.operators import select as S
from fintally.plans import views as V
from tests.conftest import SF_SMALL
from tests.helpers import ledger


def test_balances_at_many_dates_equal_one_date_at_a_time(spark):
    accounts, led = V.accounts(spark, SF_SMALL), V.ledger(spark, SF_SMALL)
    # a hot account: two thirds of all rows
    first = accounts.orderBy("id").first()["id"]
    led = led.withColumn("account_id", F.when(F.col("id") % 3 > 0, F.lit(first)).otherwise(F.col("account_id")))
    rng = random.Random(2)
    dates = [dt.date(1996, 12, 31), dt.date(1998, 2, 28), dt.date(1998, 3, 1), *(dt.date(1992, 1, 1) + dt.timedelta(rng.randrange(4000)) for _ in range(3))]
    ids = [r["id"] for r in accounts.collect()]
    wanted = spark.createDataFrame([(i, d) for i in ids for d in dates] + [(ids[0], dates[0]), (987654, dates[0]), (ids[0], None)], "account_id long, as_of date")
    got = sorted(((r["account_id"], r["as_of"], r["balance"]) for r in AC.account_balances_at(accounts, led, wanted).collect()), key=str)
    want = sorted(((r["id"], d, r["balance"]) for d in dates for r in AC.account_balance_asof(accounts, led, d).collect()), key=str)
    assert got == want and any(b is None for *_, b in got)


def test_balances_of_quiet_accounts(spark):
    schema = "id long, name string, account_type string, initial_balance decimal(18,2), balance_as_of_date date, is_active boolean"
    from decimal import Decimal
    accounts = spark.createDataFrame([(1, "a", "checking", Decimal("5.00"), None, True), (2, "b", "credit", Decimal("7.00"), dt.date(2024, 1, 5), True)], schema)
    led = ledger(spark, [(1, "2024-01-03", 2, "M"), (2, "2024-01-03", -1, "M"), (3, "2024-02-03", 10, "M")])
    wanted = spark.createDataFrame([(i, dt.date(2024, *d)) for i in (1, 2) for d in ((1, 2), (1, 3), (1, 5), (2, 3), (9, 9))], "account_id long, as_of date")
    got = {(r["account_id"], r["as_of"].isoformat()): r["balance"] for r in AC.account_balances_at(accounts, led, wanted).collect()}
    assert [got[1, f"2024-{d}"] for d in ("01-02", "01-03", "01-05", "02-03", "09-09")] == [5.0, 6.0, 6.0, 16.0, 16.0]
    assert [got[2, f"2024-{d}"] for d in ("01-02", "01-03", "01-05", "02-03", "09-09")] == [None, None, 7.0, 7.0, 7.0]
    assert AC.account_balances_at(accounts, led, wanted.limit(0)).count() == 0


def test_backslash_in_a_merchant_pattern(spark):
    led = ledger(spark, [(1, "2024-01-01", 1, "a\\b store"), (2, "2024-01-02", 1, "ab store"), (3, "2024-01-03", 1, "A\\\\B"), (4, "2024-01-04", 1, "100%_x")])
    ids = lambda needle: sorted(r["id"] for r in S.merchant_like(led, needle).collect())
    assert ids("a\\b") == [1] and ids("\\") == [1, 3] and ids("a%b") == [1, 2, 3] and ids("b_s") == [1, 2] and ids("\\%") == [1, 3] and ids("A\\\\") == [3]
