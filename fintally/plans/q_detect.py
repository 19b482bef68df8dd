"""Registered queries: recurring payments and anomalies (§2.9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.operators import anomaly as AN
from fintally.operators import recurring as RC
from fintally.plans import views as V
from fintally.plans.registry import register


def _rec(spark, sf):
    return V.recurring_ledger(spark, sf).withColumn("is_recurring", F.lit(False)) \
        .withColumn("recurring_group_id", F.lit(None).cast("long"))


_GAPS_SQL = """
SELECT merchant, amount, COUNT(*) AS n, COUNT(*) - 1 AS m,
       CAST(COALESCE(SUM(gap), 0) AS HUGEINT) AS S, CAST(COALESCE(SUM(gap * gap), 0) AS HUGEINT) AS Q
FROM (SELECT merchant, amount, date - lag(date) OVER (PARTITION BY merchant, amount ORDER BY date, id) AS gap
      FROM {src}) GROUP BY merchant, amount HAVING COUNT(*) >= 2"""


def _detect_sql(src: str) -> str:
    conds = []
    for k in [7, 14, 28, 30, 31, 90, 365]:
        t = 7 if k >= 365 else 3
        conds.append(f"WHEN ABS(S - {k} * m) <= {t} * m AND (m = 1 OR m * Q - S * S <= {t * t} * m * (m - 1)) THEN {k}")
    return f"""
SELECT merchant, CAST(amount AS DOUBLE) AS amount, n AS count,
       CAST(round_even(CAST(S AS DOUBLE) / m, 0) AS BIGINT) AS interval_days,
       CASE known WHEN 7 THEN 'weekly' WHEN 14 THEN 'biweekly' WHEN 90 THEN 'quarterly' WHEN 365 THEN 'yearly'
                  ELSE 'monthly' END AS interval_type
FROM (SELECT *, CASE {' '.join(conds)} END AS known FROM ({_GAPS_SQL.format(src=src)})) WHERE known IS NOT NULL"""


@register("recurring_detect", _detect_sql("v_recurring"))
def q_recurring_detect(spark, sf):
    return RC.recurring_detect(_rec(spark, sf)).select(
        "merchant", M.out("amount").alias("amount"), "count", "interval_days", "interval_type")


@register("recurring_detect_ledger", _detect_sql("v_ledger"))
def q_recurring_detect_ledger(spark, sf):
    return RC.recurring_detect(V.ledger(spark, sf)).select(
        "merchant", M.out("amount").alias("amount"), "count", "interval_days", "interval_type")


@register("merchant_amount_groups", """
SELECT merchant, CAST(amount AS DOUBLE) AS amount, COUNT(*) AS count, MIN(date) AS first_date, MAX(date) AS last_date
FROM v_recurring GROUP BY merchant, amount HAVING COUNT(*) >= 2""")
def q_mag(spark, sf):
    return RC.merchant_amount_groups(_rec(spark, sf)).select(
        "merchant", M.out("amount").alias("amount"), "count", "first_date", "last_date")


@register("recurring_mark", f"""
SELECT r.id, d.merchant IS NOT NULL AS is_recurring
FROM v_recurring r LEFT JOIN ({_detect_sql("v_recurring")}) d
  ON r.merchant = d.merchant AND CAST(r.amount AS DOUBLE) = d.amount""")
def q_recurring_mark(spark, sf):
    rec = _rec(spark, sf)
    return RC.recurring_mark(rec, RC.recurring_detect(rec)).select("id", "is_recurring")


@register("recurring_by_merchant", f"""
SELECT r.merchant, CAST(arg_min(r.amount, (r.date, r.id)) AS DOUBLE) AS amount, COUNT(*) AS count,
       MIN(r.date) AS first_date, MAX(r.date) AS last_date
FROM v_recurring r JOIN ({_detect_sql("v_recurring")}) d
  ON r.merchant = d.merchant AND CAST(r.amount AS DOUBLE) = d.amount
GROUP BY r.merchant""")
def q_recurring_by_merchant(spark, sf):
    rec = _rec(spark, sf)
    marked = RC.recurring_mark(rec, RC.recurring_detect(rec))
    return RC.recurring_by_merchant(marked).select(
        "merchant", M.out("amount").alias("amount"), "count", "first_date", "last_date")


_STATS_SQL = """
SELECT category_id, n, mean, std, q1, q3 FROM (
  SELECT category_id, COUNT(*) OVER w AS n,
         row_number() OVER (PARTITION BY category_id ORDER BY ABS(amount)) - 1 AS pos,
         ABS(amount) AS a FROM v_ledger WHERE category_id IS NOT NULL AND category_id <> 0
  WINDOW w AS (PARTITION BY category_id)) x
JOIN (SELECT category_id AS cid, CAST(SUM(ABS(amount)) AS DOUBLE) / COUNT(*) AS mean,
             COALESCE(STDDEV_SAMP(CAST(ABS(amount) AS DOUBLE)), 0) AS std
      FROM v_ledger WHERE category_id IS NOT NULL AND category_id <> 0 GROUP BY 1) s ON s.cid = x.category_id
JOIN (SELECT category_id AS c1, pos AS p1, a AS q1 FROM (
        SELECT category_id, ABS(amount) AS a,
               row_number() OVER (PARTITION BY category_id ORDER BY ABS(amount)) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY category_id) AS n FROM v_ledger
        WHERE category_id IS NOT NULL AND category_id <> 0) WHERE pos = n // 4) a1 ON a1.c1 = x.category_id
JOIN (SELECT category_id AS c3, a AS q3 FROM (
        SELECT category_id, ABS(amount) AS a,
               row_number() OVER (PARTITION BY category_id ORDER BY ABS(amount)) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY category_id) AS n FROM v_ledger
        WHERE category_id IS NOT NULL AND category_id <> 0) WHERE pos = (3 * n) // 4) a3 ON a3.c3 = x.category_id
WHERE x.pos = 0"""


@register("category_stats", f"""
SELECT category_id, n, mean, ROUND(std, 6) AS std, CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3
FROM ({_STATS_SQL})""")
def q_category_stats(spark, sf):
    st = AN.category_stats(V.ledger(spark, sf))
    return st.select("category_id", "n", "mean",
                     M.round_double(F.col("std"), 6).alias("std"),
                     M.out("q1").alias("q1"), M.out("q3").alias("q3"))


_BOUNDS_SQL = f"""
SELECT category_id, q1, q3,
       CASE WHEN q3 - q1 = 0 THEN q1 * (1 - 1.5) ELSE q1 - 1.5 * (q3 - q1) END AS lower_bound,
       CASE WHEN q3 - q1 = 0 THEN q3 * (1 + 1.5) ELSE q3 + 1.5 * (q3 - q1) END AS upper_bound
FROM ({_STATS_SQL}) WHERE q1 > 0 OR q3 > 0"""

_IQR_SQL = f"""
SELECT t.id, ABS(t.amount) > b.upper_bound AS above,
       NOT (ABS(t.amount) > b.upper_bound) AND ABS(t.amount) < b.lower_bound AND b.lower_bound > 0 AS below,
       b.lower_bound, b.upper_bound
FROM v_ledger t JOIN ({_BOUNDS_SQL}) b ON t.category_id = b.category_id
WHERE t.category_id IS NOT NULL AND t.category_id <> 0
  AND (ABS(t.amount) > b.upper_bound OR (ABS(t.amount) < b.lower_bound AND b.lower_bound > 0))"""


@register("anomaly_iqr", f"""
SELECT id, above, below, CAST(lower_bound AS DOUBLE) AS lower_bound, CAST(upper_bound AS DOUBLE) AS upper_bound
FROM ({_IQR_SQL})""")
def q_anomaly_iqr(spark, sf):
    return AN.anomaly_iqr(V.ledger(spark, sf)).select(
        "id", "above", "below", M.out("lower_bound").alias("lower_bound"), M.out("upper_bound").alias("upper_bound"))


_MEDIAN_SQL = """(SELECT SUM(a) * (CASE WHEN MAX(n) % 2 = 1 THEN 1 ELSE 0.5 END) FROM (
    SELECT ABS(amount) AS a, row_number() OVER (ORDER BY ABS(amount)) - 1 AS pos, COUNT(*) OVER () AS n
    FROM v_ledger) WHERE pos = (n - 1) // 2 OR pos = n // 2)"""

_NEWM_SQL = f"""
SELECT t.id, {_MEDIAN_SQL} * 3 AS threshold
FROM v_ledger t WHERE t.merchant IN (SELECT merchant FROM v_ledger GROUP BY merchant HAVING COUNT(*) = 1)
  AND ABS(t.amount) > {_MEDIAN_SQL} * 3
  AND {_MEDIAN_SQL} * 3 > 0"""


@register("anomaly_new_merchant", f"SELECT id, CAST(threshold AS DOUBLE) AS threshold FROM ({_NEWM_SQL})")
def q_anomaly_new_merchant(spark, sf):
    return AN.anomaly_new_merchant(V.ledger(spark, sf)).select("id", M.out("threshold").alias("threshold"))


@register("global_median", f"SELECT CAST({_MEDIAN_SQL} AS DOUBLE) AS median")
def q_global_median(spark, sf):
    return AN.global_median_abs(V.ledger(spark, sf)).select(M.out("median").alias("median"))


@register("anomaly_report", f"""
SELECT COALESCE(i.id, n.id) AS transaction_id, COALESCE(i.above, FALSE) AS above, COALESCE(i.below, FALSE) AS below,
       n.id IS NOT NULL AS new_merchant
FROM ({_IQR_SQL}) i FULL OUTER JOIN ({_NEWM_SQL}) n ON i.id = n.id""")
def q_anomaly_report(spark, sf):
    return AN.anomaly_report(V.ledger(spark, sf)).select("transaction_id", "above", "below", "new_merchant")


@register("anomaly_mark", f"""
WITH found AS (SELECT i.id FROM ({_IQR_SQL}) i UNION SELECT n.id FROM ({_NEWM_SQL}) n)
SELECT t.id, t.is_anomaly OR t.id IN (SELECT id FROM found) AS is_anomaly FROM v_ledger t""")
def q_anomaly_mark(spark, sf):
    led = V.ledger(spark, sf)
    marked = AN.mark_anomalies(led, AN.anomaly_report(led))
    return marked.select("id", "is_anomaly")
