"""Registered analytics queries over the derived ledger (§2.6 aggregations)."""
from __future__ import annotations

from fintally.operators import analytics as A
from fintally.plans import views as V
from fintally.plans.oracle_views import AS_OF
from fintally.plans.registry import register

_MB12 = f"(date_trunc('month', {AS_OF}) - INTERVAL 12 MONTH + (day({AS_OF}) - 1) * INTERVAL 1 DAY)"
_MB6 = f"(date_trunc('month', {AS_OF}) - INTERVAL 6 MONTH + (day({AS_OF}) - 1) * INTERVAL 1 DAY)"


@register("monthly_totals", f"""
SELECT strftime(date, '%Y-%m') AS month,
       CAST(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS income,
       CAST(SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS expenses
FROM v_ledger WHERE date >= CAST({_MB12} AS DATE)
GROUP BY 1""")
def q_monthly_totals(spark, sf):
    return A.monthly_totals(V.ledger(spark, sf), V.AS_OF, 12)


SUMMARY_TOTALS_SQL = """
SELECT COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_income,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END), 0) AS DOUBLE) AS total_expenses,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0)
            - COALESCE(SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END), 0) AS DOUBLE) AS net,
       COUNT(*) FILTER (WHERE is_recurring) AS recurring_transactions,
       CAST(COALESCE(SUM(CASE WHEN is_recurring THEN ABS(amount) END), 0) AS DOUBLE) AS estimated_monthly_recurring,
       COUNT(*) FILTER (WHERE is_anomaly) AS anomalies,
       COUNT(*) FILTER (WHERE category_id IS NULL OR category_id = 0) AS uncategorized
FROM v_ledger"""


@register("summary_totals", SUMMARY_TOTALS_SQL)
def q_summary_totals(spark, sf):
    return A.summary_totals(V.ledger(spark, sf))


@register("summary_by_category", """
SELECT t.category_id, c.name AS category, COUNT(*) AS count,
       CAST(SUM(ABS(t.amount)) AS DOUBLE) AS total,
       CAST(SUM(ABS(t.amount)) AS DOUBLE) / COUNT(*) AS average
FROM v_ledger t JOIN v_categories c ON t.category_id = c.id
GROUP BY t.category_id, c.name""")
def q_summary_by_category(spark, sf):
    return A.summary_by_category(V.ledger(spark, sf), V.categories(spark))


@register("category_totals", """
SELECT c.id, c.name, CAST(COALESCE(SUM(ABS(t.amount)), 0) AS DOUBLE) AS total, COUNT(t.id) AS count
FROM v_categories c LEFT JOIN v_ledger t ON t.category_id = c.id AND t.amount < 0
     AND strftime(t.date, '%Y-%m') = '2001-07'
GROUP BY c.id, c.name""")
def q_category_totals(spark, sf):
    return A.category_totals(V.ledger(spark, sf), V.categories(spark), 2001, 7)


@register("category_totals_all_time", """
SELECT c.id, c.name, CAST(COALESCE(SUM(ABS(t.amount)), 0) AS DOUBLE) AS total, COUNT(t.id) AS count
FROM v_categories c LEFT JOIN v_ledger t ON t.category_id = c.id AND t.amount < 0
GROUP BY c.id, c.name""")
def q_category_totals_all(spark, sf):
    return A.category_totals(V.ledger(spark, sf), V.categories(spark))


@register("category_totals_with_splits", """
SELECT c.id, c.name, CAST(COALESCE(SUM(u.amt), 0) AS DOUBLE) AS total, COUNT(u.amt) AS count
FROM v_categories c LEFT JOIN (
    SELECT category_id, ABS(amount) AS amt FROM v_ledger WHERE amount < 0 AND NOT is_split
    UNION ALL
    SELECT s.category_id, s.amount AS amt FROM v_splits s
    JOIN v_ledger t ON s.transaction_id = t.id AND t.amount < 0
) u ON u.category_id = c.id
GROUP BY c.id, c.name""")
def q_category_totals_with_splits(spark, sf):
    return A.category_totals_with_splits(V.ledger(spark, sf), V.splits(spark, sf), V.categories(spark))


@register("daily_spending", f"""
SELECT date, CAST(SUM(ABS(amount)) AS DOUBLE) AS total
FROM v_ledger WHERE amount < 0 AND date >= CAST({AS_OF} - INTERVAL 30 DAY AS DATE)
GROUP BY date""")
def q_daily_spending(spark, sf):
    return A.daily_spending(V.ledger(spark, sf), V.AS_OF, 30)


@register("daily_spending_year", f"""
SELECT date, CAST(SUM(ABS(amount)) AS DOUBLE) AS total
FROM v_ledger WHERE amount < 0 AND date >= CAST({AS_OF} - INTERVAL 365 DAY AS DATE)
GROUP BY date""")
def q_daily_spending_year(spark, sf):
    return A.daily_spending(V.ledger(spark, sf), V.AS_OF, 365)


@register("top_merchants", f"""
SELECT merchant, CAST(SUM(ABS(amount)) AS DOUBLE) AS total, COUNT(*) AS count
FROM v_ledger WHERE amount < 0 AND date >= CAST({AS_OF} - INTERVAL 90 DAY AS DATE)
GROUP BY merchant ORDER BY SUM(ABS(amount)) DESC, merchant LIMIT 10""")
def q_top_merchants(spark, sf):
    return A.top_merchants(V.ledger(spark, sf), V.AS_OF, 10, 90)


@register("top_merchants_net", """
SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS count
FROM v_ledger GROUP BY merchant ORDER BY ABS(SUM(amount)) DESC, merchant LIMIT 20""")
def q_top_merchants_net(spark, sf):
    return A.top_merchants_net(V.ledger(spark, sf), 20)


@register("weekday_spending", """
SELECT CAST(dayofweek(date) AS BIGINT) AS day_num,
       ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][dayofweek(date) + 1] AS day,
       CAST(SUM(ABS(amount)) AS DOUBLE) / COUNT(*) AS avg,
       CAST(SUM(ABS(amount)) AS DOUBLE) AS total
FROM v_ledger WHERE amount < 0 GROUP BY 1, 2""")
def q_weekday_spending(spark, sf):
    return A.weekday_spending(V.ledger(spark, sf))


@register("category_trend", f"""
SELECT category_id, strftime(date, '%Y-%m') AS month, CAST(SUM(ABS(amount)) AS DOUBLE) AS total
FROM v_ledger WHERE amount < 0 AND category_id IS NOT NULL AND date >= CAST({_MB6} AS DATE)
GROUP BY 1, 2""")
def q_category_trend(spark, sf):
    return A.category_trend(V.ledger(spark, sf), V.AS_OF, None, 6)


@register("category_trend_one", f"""
SELECT category_id, strftime(date, '%Y-%m') AS month, CAST(SUM(ABS(amount)) AS DOUBLE) AS total
FROM v_ledger WHERE amount < 0 AND category_id = 3 AND date >= CAST({_MB12} AS DATE)
GROUP BY 1, 2""")
def q_category_trend_one(spark, sf):
    return A.category_trend(V.ledger(spark, sf), V.AS_OF, 3, 12)


@register("category_spending", """
SELECT category_id, CAST(SUM(ABS(amount)) AS DOUBLE) AS spent
FROM v_ledger WHERE amount < 0 AND category_id IS NOT NULL AND strftime(date, '%Y-%m') = '2001-07'
GROUP BY 1""")
def q_category_spending(spark, sf):
    return A.category_spending(V.ledger(spark, sf), 2001, 7)


CATEGORY_STATUS_SQL = """
SELECT c.id, c.name, CAST(c.budget_amount AS DOUBLE) AS budget_amount,
       COALESCE(a.transaction_count, 0) AS transaction_count,
       CAST(COALESCE(a.spent, 0) AS DOUBLE) AS spent,
       CASE WHEN c.budget_amount > 0
            THEN LEAST(100.0, CAST(COALESCE(a.spent, 0) AS DOUBLE) / CAST(c.budget_amount AS DOUBLE) * 100)
            ELSE 0.0 END AS budget_percent
FROM v_categories c LEFT JOIN (
    SELECT category_id, COUNT(*) AS transaction_count,
           SUM(CASE WHEN amount < 0 AND strftime(date, '%Y-%m') = '2001-07' THEN ABS(amount) END) AS spent
    FROM v_ledger WHERE category_id IS NOT NULL GROUP BY category_id) a ON a.category_id = c.id"""


@register("category_status", CATEGORY_STATUS_SQL)
def q_category_status(spark, sf):
    return A.category_status(V.ledger(spark, sf), V.categories(spark), 2001, 7)


@register("category_share", """
WITH ct AS (
  SELECT c.id, c.name, CAST(COALESCE(SUM(ABS(t.amount)), 0) AS DOUBLE) AS total
  FROM v_categories c LEFT JOIN v_ledger t ON t.category_id = c.id AND t.amount < 0
  GROUP BY c.id, c.name)
SELECT id, name, total,
       CASE WHEN (SELECT CAST(SUM(CAST(total AS DECIMAL(20,2))) AS DOUBLE) FROM ct) > 0
            THEN total / (SELECT CAST(SUM(CAST(total AS DECIMAL(20,2))) AS DOUBLE) FROM ct) * 100 ELSE 0.0 END AS share_pct
FROM ct""")
def q_category_share(spark, sf):
    ct = A.category_totals(V.ledger(spark, sf), V.categories(spark)).select("id", "name", "total")
    return A.category_share(ct)
