"""Anomaly detection on the reference's literal fixtures, plus the exact order statistics."""
import random

from pyspark.sql import functions as F

from fintally.operators import anomaly as AN
from fintally.operators.stats import kth_smallest
from tests.helpers import ledger


def _flagged(spark, rows):
    return {r["transaction_id"]: r for r in AN.anomaly_report(ledger(spark, rows)).collect()}


def test_category_outlier(spark):
    rows = [(1, "2024-01-01", -50, "A", 3), (2, "2024-01-02", -45, "B", 3), (3, "2024-01-03", -55, "A", 3),
            (4, "2024-01-04", -48, "B", 3), (5, "2024-01-05", -500, "A", 3)]
    f = _flagged(spark, rows)
    assert 5 in f and f[5]["above"]


def test_new_merchant_high_amount(spark):
    rows = [(i, f"2024-01-0{i}", -30, "REGULAR", 1) for i in range(1, 6)] + [(6, "2024-01-06", -500, "NEW SHOP", 2)]
    f = _flagged(spark, rows)
    assert 6 in f and f[6]["new_merchant"]


def test_normal_range_not_flagged(spark):
    rows = [(i, f"2024-01-0{i}", -a, "S", 3) for i, a in enumerate([45, 50, 55, 48, 52], start=1)]
    assert _flagged(spark, rows) == {}


def test_zero_iqr(spark):
    rows = [(i, f"2024-01-0{i}", -50, "S", 3) for i in range(1, 5)] + [(5, "2024-01-05", -500, "S", 3)]
    st = AN.category_stats(ledger(spark, rows)).collect()[0]
    assert float(st["q1"]) == 50 and float(st["q3"]) == 50
    f = _flagged(spark, rows)
    assert 5 in f and f[5]["above"] and float(f[5]["upper_bound"]) == 125.0


def test_single_row_no_failure(spark):
    rows = [(1, "2024-01-01", -500, "ONLY", 3)]
    AN.anomaly_report(ledger(spark, rows)).collect()


def test_empty(spark):
    assert AN.anomaly_report(ledger(spark, [])).count() == 0


def test_index_quartiles_match_python(spark):
    rnd = random.Random(7)
    rows = [(i, "2024-01-01", -rnd.choice([1, 2, 3, 5, 8, 13, 21, 1000.55]), "M", 1 + i % 3) for i in range(200)]
    st = {r["category_id"]: r for r in AN.category_stats(ledger(spark, rows)).collect()}
    for cat in (1, 2, 3):
        vals = sorted(abs(r[2]) for r in rows if r[4] == cat)
        n = len(vals)
        assert float(st[cat]["q1"]) == vals[n // 4] and float(st[cat]["q3"]) == vals[3 * n // 4]


def test_kth_smallest_against_sorting(spark):
    rnd = random.Random(11)
    data = [(g, rnd.randrange(0, 1 << 40)) for g in range(3) for _ in range(300)]
    data += [(9, 5)] * 50  # a hot group of equal values
    df = spark.createDataFrame(data, "g long, v long")
    targets = spark.createDataFrame([(g, "t", r) for g in (0, 1, 2) for r in (0, 17, 150, 299)] + [(9, "t", 49)],
                                    "g long, tag string, rank long")
    got = {(r["g"], r["rank"]): r["kth"] for r in kth_smallest(df, ["g"], "v", targets).collect()}
    for (g, r), v in got.items():
        assert sorted(x for gg, x in data if gg == g)[r] == v
    assert len(got) == 13


def test_global_median_even_count(spark):
    rows = [(i, "2024-01-01", -a, "M", 1) for i, a in enumerate([10, 20, 30, 41], start=1)]
    m = AN.global_median_abs(ledger(spark, rows)).select(F.col("median").cast("double")).collect()[0][0]
    assert m == 25.0
