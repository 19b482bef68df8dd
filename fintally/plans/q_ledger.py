"""Registered queries: selection/lookups, accounts, budgets, bills and goals."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.schedule import next_due_date
from fintally.operators import accounts as AC
from fintally.operators import bills as BL
from fintally.operators import budget as BU
from fintally.operators import goals as GO
from fintally.operators import select as S
from fintally.plans import views as V
from fintally.plans.oracle_views import AS_OF, AS_OF_TS
from fintally.plans.registry import ORACLE_BODY, register
from fintally.templates import category_map_df, templates_df

_TXN_COLS = ["id", "date", "merchant", "description", "category_id", "account_id"]


def _txn_out(df):
    return df.select(*_TXN_COLS, M.out("amount").alias("amount"))


_TXN_SQL = "id, date, merchant, description, category_id, account_id, CAST(amount AS DOUBLE) AS amount"

# --- §2.4 selection ----------------------------------------------------------


@register("txn_list", f"""
SELECT {_TXN_SQL} FROM v_ledger
WHERE (contains(lower(merchant), 'customer#00000012') OR contains(lower(coalesce(description, '')), 'customer#00000012'))
ORDER BY amount DESC, id LIMIT 50 OFFSET 10""")
def q_txn_list_page(spark, sf):
    page, _ = S.txn_list(V.ledger(spark, sf), V.categories(spark), search="Customer#00000012",
                         sort_by="amount", desc=True, limit=50, offset=10)
    return _txn_out(page)


@register("txn_list_total", """
SELECT COUNT(*) AS total FROM v_ledger t JOIN v_categories c ON t.category_id = c.id AND c.name = 'Shopping'
WHERE contains(lower(t.merchant), 'urgent') OR contains(lower(coalesce(t.description, '')), 'urgent')""")
def q_txn_list_total(spark, sf):
    _, total = S.txn_list(V.ledger(spark, sf), V.categories(spark), category="Shopping", search=" URGENT ")
    return total


@register("txn_list_by_merchant_name", f"""
SELECT {_TXN_SQL} FROM v_ledger ORDER BY lower(merchant) ASC, id LIMIT 25""")
def q_txn_list_merchant(spark, sf):
    page, _ = S.txn_list(V.ledger(spark, sf), V.categories(spark), sort_by="merchant", desc=False, limit=25)
    return _txn_out(page)


@register("txn_by_merchant", f"""
SELECT {_TXN_SQL} FROM v_ledger WHERE merchant IN (SELECT merchant FROM v_bills WHERE NOT is_active)""")
def q_txn_by_merchant(spark, sf):
    keys = V.bills(spark, sf).filter(~F.col("is_active")).select("merchant")
    return _txn_out(S.txn_by_keys(V.ledger(spark, sf), keys, "merchant"))


@register("txn_by_category", f"""
SELECT {_TXN_SQL} FROM v_ledger WHERE category_id IN (SELECT id FROM v_categories WHERE budget_amount = 0)""")
def q_txn_by_category(spark, sf):
    keys = V.categories(spark).filter(F.col("budget_amount") == 0).select(F.col("id").alias("category_id"))
    return _txn_out(S.txn_by_keys(V.ledger(spark, sf), keys, "category_id"))


@register("txn_by_account", f"""
SELECT {_TXN_SQL}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, id) AS rank FROM v_ledger
  WHERE account_id IS NOT NULL) WHERE rank <= 100""")
def q_txn_by_account(spark, sf):
    df = S.txn_by_account_recent(V.ledger(spark, sf), 100)
    return df.select(*_TXN_COLS, M.out("amount").alias("amount"), F.col("rank").cast("long").alias("rank"))


@register("txn_uncategorized", f"SELECT {_TXN_SQL} FROM v_ledger WHERE category_id IS NULL")
def q_txn_uncat(spark, sf):
    return _txn_out(S.txn_uncategorized(V.ledger(spark, sf)))


@register("txn_uncategorized_unsplit", f"SELECT {_TXN_SQL} FROM v_ledger WHERE category_id IS NULL AND NOT is_split")
def q_txn_uncat2(spark, sf):
    return _txn_out(S.txn_uncategorized(V.ledger(spark, sf), exclude_split=True))


@register("txn_anomalies", f"SELECT {_TXN_SQL} FROM v_ledger WHERE is_anomaly")
def q_txn_anom(spark, sf):
    return _txn_out(S.txn_anomalies(V.ledger(spark, sf)))


@register("merchant_like", f"""
SELECT {_TXN_SQL} FROM v_ledger WHERE lower(merchant) LIKE '%customer#0000001_2%' ORDER BY date DESC, id LIMIT 50""")
def q_merchant_like(spark, sf):
    return _txn_out(S.merchant_like(V.ledger(spark, sf), "Customer#0000001_2", 50))


@register("merchants_distinct", "SELECT DISTINCT merchant FROM v_ledger")
def q_merchants_distinct(spark, sf):
    return S.merchants_distinct(V.ledger(spark, sf))


@register("lookup_by_keys", f"""
SELECT {_TXN_SQL} FROM v_ledger WHERE id IN (SELECT transaction_id FROM v_splits)""")
def q_lookup(spark, sf):
    keys = V.splits(spark, sf).select(F.col("transaction_id").alias("id"))
    return _txn_out(S.lookup_by_keys(V.ledger(spark, sf), keys, "id"))


@register("active_accounts", """
SELECT id, name, account_type, CAST(initial_balance AS DOUBLE) AS initial_balance FROM v_accounts WHERE is_active""")
def q_active_accounts(spark, sf):
    return S.active_accounts(V.accounts(spark, sf)).select(
        "id", "name", "account_type", M.out("initial_balance").alias("initial_balance"))


@register("active_rules", """
SELECT r.id, r.name, r.rule_type, r.pattern, r.category_id, r.priority, c.name AS category_name
FROM v_part_rules r JOIN v_categories c ON r.category_id = c.id WHERE r.is_active""")
def q_active_rules(spark, sf):
    return S.active_rules(V.part_rules(spark, sf), V.categories(spark)).select(
        "id", "name", "rule_type", "pattern", "category_id", "priority", "category_name")


@register("active_bills", """
SELECT b.id, b.name, b.next_due_date, c.name AS category_name, a.name AS account_name
FROM v_bills b LEFT JOIN v_categories c ON b.category_id = c.id LEFT JOIN v_accounts a ON b.account_id = a.id
WHERE b.is_active""")
def q_active_bills(spark, sf):
    return S.active_bills(V.bills(spark, sf), V.categories(spark), V.accounts(spark, sf)).select(
        "id", "name", "next_due_date", "category_name", "account_name")


@register("category_budgets", """
SELECT id, name, CAST(budget_amount AS DOUBLE) AS budget_amount FROM v_supplier_categories WHERE budget_amount > 0""")
def q_category_budgets(spark, sf):
    return S.category_budgets(V.supplier_categories(spark, sf)).select("id", "name", M.out("budget_amount").alias("budget_amount"))


@register("latest_log", """
SELECT transaction_id, id, category_id, confidence, explanation FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id
                               ORDER BY created_at DESC, id DESC, category_id DESC, confidence DESC, explanation DESC) AS rn
  FROM v_log) WHERE rn = 1""")
def q_latest_log(spark, sf):
    log = V.categorization_log(spark, sf)
    # the test log repeats (created_at, id) pairs, so the remaining columns break ties
    latest = S.latest_log(log, order=("created_at", "id", "category_id", "confidence", "explanation"))
    return latest.select("transaction_id", "id", "category_id", "confidence", "explanation")


@register("settings_typed", """
SELECT key, value AS value_text,
       CASE WHEN contains(value, '.') THEN TRY_CAST(value AS DOUBLE)
            ELSE CAST(TRY_CAST(value AS BIGINT) AS DOUBLE) END AS value_num,
       CASE WHEN contains(value, '.') THEN 'float' WHEN TRY_CAST(value AS BIGINT) IS NOT NULL THEN 'int'
            ELSE 'text' END AS value_type
FROM v_customer_settings""")
def q_settings_typed(spark, sf):
    return S.settings_typed(V.customer_settings(spark, sf))


# --- accounts ----------------------------------------------------------------

_BAL_SQL = """
SELECT a.id, a.name, a.account_type,
       CAST(CASE WHEN a.balance_as_of_date IS NOT NULL AND {asof} < a.balance_as_of_date THEN NULL
                 WHEN a.account_type = 'credit' THEN a.initial_balance - COALESCE(s.txn_sum, 0)
                 ELSE a.initial_balance + COALESCE(s.txn_sum, 0) END AS DOUBLE) AS balance
FROM v_accounts a LEFT JOIN (
   SELECT t.account_id, SUM(t.amount) AS txn_sum FROM v_ledger t JOIN v_accounts a2 ON t.account_id = a2.id
   WHERE (a2.balance_as_of_date IS NULL OR t.date > a2.balance_as_of_date) AND t.date <= {asof}
   GROUP BY t.account_id) s ON s.account_id = a.id"""


@register("account_balance_asof", _BAL_SQL.format(asof="DATE '2000-06-30'"))
def q_balance(spark, sf):
    return AC.account_balance_asof(V.accounts(spark, sf), V.ledger(spark, sf), dt.date(2000, 6, 30))


@register("account_balance_before_known", _BAL_SQL.format(asof="DATE '1997-06-30'"))
def q_balance_early(spark, sf):
    return AC.account_balance_asof(V.accounts(spark, sf), V.ledger(spark, sf), dt.date(1997, 6, 30))


@register("txn_list_deep", """
SELECT id, date, CAST(amount AS DOUBLE) AS amount, merchant FROM v_ledger ORDER BY date DESC, id LIMIT 60 OFFSET 900""")
def q_txn_list_deep(spark, sf):
    """A page far down the list, located by counts."""
    page = S.txn_page(V.ledger(spark, sf), V.categories(spark), 900, 60)
    return page.select("id", "date", M.out("amount").alias("amount"), "merchant")


@register("account_balances_monthly", """
WITH w AS (SELECT a.id AS account_id, last_day(m) AS as_of, a.* EXCLUDE (id) FROM v_accounts a,
           (SELECT unnest(generate_series(DATE '1997-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS m))
SELECT w.account_id, w.as_of, CAST(CASE WHEN w.as_of < MIN(w.balance_as_of_date) THEN NULL
         WHEN MIN(w.account_type) = 'credit' THEN MIN(w.initial_balance) - COALESCE(SUM(t.amount), 0)
         ELSE MIN(w.initial_balance) + COALESCE(SUM(t.amount), 0) END AS DOUBLE) AS balance
FROM w LEFT JOIN v_ledger t ON t.account_id = w.account_id AND t.date <= w.as_of AND (w.balance_as_of_date IS NULL OR t.date > w.balance_as_of_date)
GROUP BY w.account_id, w.as_of""")
def q_balances_monthly(spark, sf):
    """Every account's balance at the end of every month of five years."""
    accounts = V.accounts(spark, sf)
    months = F.expr("sequence(DATE'1997-01-01', DATE'2001-12-01', INTERVAL 1 MONTH)")
    wanted = accounts.select(F.col("id").alias("account_id"), F.explode(months).alias("m")).select("account_id", F.last_day("m").alias("as_of"))
    return AC.account_balances_at(accounts, V.ledger(spark, sf), wanted)


_STATUS_SQL = f"""
SELECT a.id, a.name, a.account_type,
       CAST(CASE WHEN a.account_type = 'credit' THEN a.initial_balance - COALESCE(s.txn_sum, 0)
                 ELSE a.initial_balance + COALESCE(s.txn_sum, 0) END AS DOUBLE) AS balance,
       COALESCE(s.n, 0) AS transaction_count,
       CAST(ABS(COALESCE(s.m_exp, 0)) AS DOUBLE) AS spending_this_month,
       CAST(COALESCE(s.m_inc, 0) AS DOUBLE) AS income_this_month,
       CAST(CASE WHEN a.account_type = 'credit' THEN a.initial_balance END AS DOUBLE) AS credit_limit,
       CAST(CASE WHEN a.account_type = 'credit'
                 THEN GREATEST(0, a.initial_balance - (a.initial_balance - COALESCE(s.txn_sum, 0))) END AS DOUBLE)
            AS available_credit,
       CASE WHEN a.account_type = 'credit' THEN 'Owed' ELSE 'Balance' END AS balance_label
FROM v_accounts a LEFT JOIN (
   SELECT t.account_id,
          SUM(CASE WHEN a2.balance_as_of_date IS NULL OR t.date > a2.balance_as_of_date THEN t.amount END) AS txn_sum,
          COUNT(*) AS n,
          SUM(CASE WHEN t.amount < 0 AND strftime(t.date, '%Y-%m') = '2001-07' THEN t.amount END) AS m_exp,
          SUM(CASE WHEN t.amount > 0 AND strftime(t.date, '%Y-%m') = '2001-07' THEN t.amount END) AS m_inc
   FROM v_ledger t JOIN v_accounts a2 ON t.account_id = a2.id GROUP BY t.account_id) s ON s.account_id = a.id
WHERE a.is_active"""


@register("account_status", _STATUS_SQL)
def q_account_status(spark, sf):
    return AC.account_status(V.accounts(spark, sf), V.ledger(spark, sf), dt.date(2001, 7, 15))


@register("net_worth", f"""
WITH st AS ({_STATUS_SQL})
SELECT CAST(SUM(CASE WHEN account_type <> 'credit' THEN CAST(balance AS DECIMAL(18,2)) ELSE 0 END)
          - SUM(CASE WHEN account_type = 'credit' THEN CAST(balance AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS net_worth,
       CAST(SUM(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS total_balance,
       CAST(SUM(CASE WHEN account_type = 'credit' THEN CAST(COALESCE(available_credit, 0) AS DECIMAL(18,2)) ELSE 0 END)
            AS DOUBLE) AS total_available_credit
FROM st""")
def q_net_worth(spark, sf):
    st = AC.account_status(V.accounts(spark, sf), V.ledger(spark, sf), dt.date(2001, 7, 15))
    return AC.net_worth(st)


# --- budgets -----------------------------------------------------------------

_MONTHLY_SQL = """CAST((CASE b.frequency WHEN 'daily' THEN ABS(b.amount) * 30
      WHEN 'weekly' THEN ABS(b.amount) * CAST(4.33 AS DECIMAL(3,2))
      WHEN 'biweekly' THEN ABS(b.amount) * CAST(2.17 AS DECIMAL(3,2))
      WHEN 'quarterly' THEN CAST(CAST(ABS(b.amount) AS DOUBLE) / 3 AS DECIMAL(30,6))
      WHEN 'yearly' THEN CAST(CAST(ABS(b.amount) AS DOUBLE) / 12 AS DECIMAL(30,6))
      WHEN 'annually' THEN CAST(CAST(ABS(b.amount) AS DOUBLE) / 12 AS DECIMAL(30,6))
      ELSE ABS(b.amount) END) AS DECIMAL(30,6))"""

_FIXED_BILLS_SQL = f"""
SELECT b.*, c.name AS category_name, {_MONTHLY_SQL} AS monthly
FROM v_bills b LEFT JOIN v_categories c ON b.category_id = c.id WHERE b.is_active"""


@register("fixed_costs", f"""
WITH fb AS ({_FIXED_BILLS_SQL})
SELECT COALESCE(category_name, 'Uncategorized') AS category, CAST(ROUND(SUM(monthly), 2) AS DOUBLE) AS total,
       COUNT(*) AS bill_count, FALSE AS is_total
FROM fb GROUP BY 1
UNION ALL
SELECT NULL, CAST(ROUND(SUM(monthly), 2) AS DOUBLE), COUNT(*), TRUE FROM fb""")
def q_fixed_costs(spark, sf):
    return BU.fixed_costs(V.bills(spark, sf), V.categories(spark))


@register("bill_monthly_equivalent", f"""
WITH fb AS ({_FIXED_BILLS_SQL})
SELECT id, name, frequency, category_name, CAST(ROUND(monthly, 2) AS DOUBLE) AS monthly_equivalent FROM fb""")
def q_fixed_cost_bills(spark, sf):
    return BU.fixed_costs_bills(V.bills(spark, sf), V.categories(spark)).select(
        "id", "name", "frequency", "category_name", "monthly_equivalent")


_BUDGET_CATS_SQL = """
SELECT c.id, c.name, CAST(c.budget_amount AS DOUBLE) AS budget_amount,
       CAST(COALESCE(s.spent, 0) AS DOUBLE) AS spent,
       CAST(c.budget_amount - COALESCE(s.spent, 0) AS DOUBLE) AS remaining,
       ROUND(CAST(COALESCE(s.spent, 0) AS DOUBLE) / CAST(c.budget_amount AS DOUBLE) * 100, 1) AS percent_used,
       COALESCE(s.spent, 0) > c.budget_amount AS over_budget
FROM v_categories c LEFT JOIN (
  SELECT category_id, SUM(ABS(amount)) AS spent FROM v_ledger
  WHERE date >= DATE '2001-07-01' AND date < DATE '2001-08-01' AND amount < 0 GROUP BY category_id) s
  ON s.category_id = c.id
WHERE c.budget_amount > 0"""


@register("budget_categories", _BUDGET_CATS_SQL)
def q_budget_categories(spark, sf):
    return BU.budget_categories(V.ledger(spark, sf), V.categories(spark), V.BUDGET_MONTH)


_OVERVIEW_SQL = f"""
WITH fb AS ({_FIXED_BILLS_SQL}),
     bc AS ({_BUDGET_CATS_SQL}),
     p AS (SELECT 30000000.0 AS income, 20.0 AS pct,
                  (SELECT CAST(COALESCE(ROUND(SUM(monthly), 2), 0) AS DOUBLE) FROM fb) AS fixed,
                  (SELECT CAST(COALESCE(SUM(ABS(amount)), 0) AS DOUBLE) FROM v_ledger
                   WHERE amount < 0 AND date >= DATE '2001-07-01' AND date < DATE '2001-08-01') AS spent,
                  (SELECT CAST(COALESCE(SUM(CAST(budget_amount AS DECIMAL(18,2))), 0) AS DOUBLE) FROM bc) AS tb,
                  (SELECT CAST(COALESCE(SUM(CAST(spent AS DECIMAL(18,2))), 0) AS DOUBLE) FROM bc) AS ts),
     q AS (SELECT *, income * (pct / 100.0) AS savings, income - fixed - income * (pct / 100.0) AS disc FROM p)
SELECT '2001-07' AS month, income AS monthly_income, income > 0 AS income_is_set, fixed AS total_fixed,
       pct AS savings_target_percent, ROUND(savings, 2) AS savings_target, ROUND(disc, 2) AS discretionary_budget,
       ROUND(spent, 2) AS total_spent, ROUND(disc - spent, 2) AS discretionary_remaining,
       CASE WHEN disc > 0 THEN ROUND(spent / disc * 100, 1) ELSE 0.0 END AS percent_used,
       (disc - spent) < 0 AS is_over, ROUND(tb, 2) AS total_budgeted, ROUND(ts, 2) AS total_spent_budgeted,
       ROUND(income - spent, 2) AS net_remaining, disc AS _disc, disc - spent AS _remaining, spent AS _spent
FROM q"""


def _overview(spark, sf):
    return BU.budget_overview(V.ledger(spark, sf), V.bills(spark, sf), V.categories(spark),
                              V.settings(spark), V.BUDGET_MONTH)


@register("budget_overview", _OVERVIEW_SQL)
def q_budget_overview(spark, sf):
    return _overview(spark, sf)


@register("budget_warnings", f"""
WITH ov AS ({_OVERVIEW_SQL.replace('WITH fb AS', 'WITH fb2 AS', 1).replace('FROM fb)', 'FROM fb2)')}),
     bc2 AS ({_BUDGET_CATS_SQL})
SELECT 'info' AS type, CAST(NULL AS BIGINT) AS category_id, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS severity
FROM ov WHERE monthly_income = 0
UNION ALL SELECT 'danger', NULL, ABS(_remaining), 'high' FROM ov WHERE _remaining < 0
UNION ALL SELECT 'warning', NULL, _spent / _disc * 100, 'medium' FROM ov
  WHERE _remaining >= 0 AND _disc > 0 AND _spent / _disc * 100 >= 80
UNION ALL SELECT 'warning', id, CAST(CAST(spent AS DECIMAL(18,2)) - CAST(budget_amount AS DECIMAL(18,2)) AS DOUBLE), NULL
FROM bc2 WHERE over_budget""")
def q_budget_warnings(spark, sf):
    ov = _overview(spark, sf)
    bc = BU.budget_categories(V.ledger(spark, sf), V.categories(spark), V.BUDGET_MONTH)
    return BU.budget_warnings(ov, bc, V.settings(spark))


@register("budget_health", f"""
WITH ov AS ({_OVERVIEW_SQL.replace('WITH fb AS', 'WITH fb2 AS', 1).replace('FROM fb)', 'FROM fb2)')})
SELECT month, CASE WHEN is_over THEN 'Over Budget' WHEN percent_used >= 80 THEN 'Getting Tight'
                   WHEN percent_used >= 50 THEN 'On Track' ELSE 'Healthy' END AS health FROM ov""")
def q_budget_health(spark, sf):
    return BU.budget_health(_overview(spark, sf))


_METHODS = ["fifty_thirty_twenty", "zero_based", "pay_yourself_first", "envelope", "minimalist"]


def _incomes(spark, sf):
    """Per account: July income as the monthly income, a method chosen by account id."""
    led = V.ledger(spark, sf)
    methods = F.array(*[F.lit(m) for m in _METHODS])
    return (led.filter((F.col("amount") > 0) & (F.col("date") >= F.lit(dt.date(2001, 7, 1)))
                       & (F.col("date") < F.lit(dt.date(2001, 8, 1))) & F.col("account_id").isNotNull())
            .groupBy(F.col("account_id").alias("owner"))
            .agg(F.sum("amount").cast("double").alias("monthly_income"))
            .withColumn("method_id", F.element_at(methods, (F.col("owner") % 5 + 1).cast("int"))))


def _templates_sql():
    from fintally.plans.oracle_views import _values
    from fintally.templates import METHOD_TEMPLATES
    rows = [(m, i, n, t, p) for i, (m, n, t, p, _k) in enumerate(METHOD_TEMPLATES)]
    return f"(VALUES {_values(rows)}) tpl(method_id, position, name, type, percent)"


_INCOMES_SQL = f"""
SELECT account_id AS owner, CAST(SUM(amount) AS DOUBLE) AS monthly_income,
       ['{"', '".join(_METHODS)}'][account_id % 5 + 1] AS method_id
FROM v_ledger WHERE amount > 0 AND date >= DATE '2001-07-01' AND date < DATE '2001-08-01' AND account_id IS NOT NULL
GROUP BY account_id"""

_ALLOC_SQL = f"""
SELECT i.owner, i.method_id, CAST(tpl.position AS INTEGER) AS position, tpl.name, tpl.type,
       CAST(tpl.percent AS INTEGER) AS percent, ROUND(i.monthly_income * (tpl.percent / 100.0), 2) AS budget_amount
FROM ({_INCOMES_SQL}) i JOIN {_templates_sql()} ON i.method_id = tpl.method_id"""


@register("method_allocation", _ALLOC_SQL)
def q_method_allocation(spark, sf):
    return BU.method_allocation(templates_df(spark), _incomes(spark, sf))


def _spend(spark, sf):
    """Per account: July spending by category name (the 'actuals' to blend in)."""
    led = V.ledger(spark, sf)
    cats = V.categories(spark).select(F.col("id").alias("category_id"), F.col("name").alias("spend_category"))
    return (led.filter((F.col("amount") < 0) & (F.col("date") >= F.lit(dt.date(2001, 7, 1)))
                       & (F.col("date") < F.lit(dt.date(2001, 8, 1))) & F.col("account_id").isNotNull())
            .join(cats, "category_id")
            .groupBy(F.col("account_id").alias("owner"), "spend_category")
            .agg(F.sum(F.abs("amount")).cast("double").alias("amount")))


@register("method_blend_actuals", f"""
WITH alloc AS ({_ALLOC_SQL}),
     spend AS (SELECT t.account_id AS owner, c.name AS spend_category, CAST(SUM(ABS(t.amount)) AS DOUBLE) AS amount
               FROM v_ledger t JOIN v_categories c ON t.category_id = c.id
               WHERE t.amount < 0 AND t.date >= DATE '2001-07-01' AND t.date < DATE '2001-08-01'
                 AND t.account_id IS NOT NULL GROUP BY 1, 2),
     cmap AS (SELECT * FROM (VALUES ('Groceries', 'Food & Dining'), ('Food & Dining', 'Food & Dining'),
              ('Dining Out', 'Food & Dining'), ('Transportation', 'Transportation'), ('Gas', 'Transportation'),
              ('Utilities', 'Utilities'), ('Entertainment', 'Entertainment'), ('Shopping', 'Shopping'),
              ('Healthcare', 'Healthcare'), ('Insurance', 'Insurance'), ('Personal Care', 'Personal Care'),
              ('Subscriptions', 'Subscriptions')) m(spend_category, template_category)),
     mapped AS (SELECT s.owner, s.spend_category AS raw, COALESCE(m.template_category, s.spend_category) AS mapped,
                       CAST(FLOOR(s.amount + 0.5) AS DOUBLE) AS rounded
                FROM spend s LEFT JOIN cmap m ON s.spend_category = m.spend_category),
     names AS (SELECT DISTINCT owner, name FROM alloc),
     act AS (SELECT owner, name, MAX(rounded) AS actual FROM (
               SELECT m.owner, m.mapped AS name, m.rounded FROM mapped m
               WHERE EXISTS (SELECT 1 FROM names n WHERE n.owner = m.owner AND n.name = m.mapped)
               UNION ALL
               SELECT m.owner, m.raw AS name, m.rounded FROM mapped m
               WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.owner = m.owner AND n.name = m.mapped)
                 AND EXISTS (SELECT 1 FROM names n WHERE n.owner = m.owner AND n.name = m.raw)) u
             GROUP BY owner, name)
SELECT a.*, act.actual, GREATEST(a.budget_amount, COALESCE(act.actual, a.budget_amount)) AS adjusted_amount
FROM alloc a LEFT JOIN act ON a.owner = act.owner AND a.name = act.name""")
def q_method_blend(spark, sf):
    alloc = BU.method_allocation(templates_df(spark), _incomes(spark, sf))
    return BU.method_blend_actuals(alloc, _spend(spark, sf), category_map_df(spark))


# --- bills -------------------------------------------------------------------

_DIMS_SQL = "LEFT JOIN v_categories c ON b.category_id = c.id LEFT JOIN v_accounts a ON b.account_id = a.id"


@register("bills_upcoming", f"""
SELECT b.id, b.name, b.next_due_date, c.name AS category_name, a.name AS account_name FROM v_bills b {_DIMS_SQL}
WHERE b.is_active AND b.next_due_date IS NOT NULL AND b.next_due_date <= CAST({AS_OF} + INTERVAL 7 DAY AS DATE)""")
def q_bills_upcoming(spark, sf):
    return BL.bills_upcoming(V.bills(spark, sf), V.categories(spark), V.accounts(spark, sf), V.AS_OF, 7) \
        .select("id", "name", "next_due_date", "category_name", "account_name")


@register("bills_overdue", f"""
SELECT b.id, b.name, b.next_due_date, c.name AS category_name, a.name AS account_name FROM v_bills b {_DIMS_SQL}
WHERE b.is_active AND b.next_due_date IS NOT NULL AND b.next_due_date < {AS_OF}""")
def q_bills_overdue(spark, sf):
    return BL.bills_overdue(V.bills(spark, sf), V.categories(spark), V.accounts(spark, sf), V.AS_OF) \
        .select("id", "name", "next_due_date", "category_name", "account_name")


_DUE_SOON_SQL = f"""
SELECT b.id, b.name, b.next_due_date, c.name AS category_name, a.name AS account_name,
       CASE WHEN b.next_due_date < CAST({AS_OF_TS} AS DATE) THEN 'overdue'
            WHEN b.next_due_date <= CAST(CAST({AS_OF_TS} AS DATE) + INTERVAL 3 DAY AS DATE) THEN 'due_soon'
            ELSE 'upcoming' END AS status,
       (epoch(CAST(b.next_due_date AS TIMESTAMP)) - epoch({AS_OF_TS})) / 86400.0 AS days_until_due
FROM v_bills b {_DIMS_SQL}
WHERE b.is_active AND b.next_due_date IS NOT NULL
  AND b.next_due_date <= CAST(CAST({AS_OF_TS} AS DATE) + INTERVAL 7 DAY AS DATE)"""


@register("bills_due_soon", _DUE_SOON_SQL)
def q_bills_due_soon(spark, sf):
    return BL.bills_due_soon(V.bills(spark, sf), V.categories(spark), V.accounts(spark, sf), V.AS_OF_TS, 7)


@register("bill_status_label", f"""
SELECT *, CASE WHEN status = 'overdue' THEN CAST(ABS(FLOOR(days_until_due)) AS BIGINT) || 'd overdue'
               WHEN days_until_due <= 0 THEN 'Due today'
               ELSE 'Due in ' || CAST(CEIL(days_until_due) AS BIGINT) || 'd' END AS label
FROM ({_DUE_SOON_SQL})""")
def q_bill_status_label(spark, sf):
    ds = BL.bills_due_soon(V.bills(spark, sf), V.categories(spark), V.accounts(spark, sf), V.AS_OF_TS, 7)
    return BL.bill_status_label(ds)


@register("subscription_status", f"""
SELECT id, name, CASE WHEN NOT is_active THEN 'Paused' WHEN next_due_date IS NULL THEN 'Unknown'
     WHEN next_due_date - {AS_OF} < 0 THEN CAST(ABS(next_due_date - {AS_OF}) AS VARCHAR) || 'd overdue'
     WHEN next_due_date - {AS_OF} = 0 THEN 'Due today'
     ELSE 'Due in ' || CAST(next_due_date - {AS_OF} AS VARCHAR) || 'd' END AS status_label
FROM v_bills""")
def q_subscription_status(spark, sf):
    return BL.subscription_status(V.bills(spark, sf), V.AS_OF)


@register("bill_summary", f"""
SELECT COUNT(*) AS total_count, COUNT(*) FILTER (WHERE is_active) AS active_count,
       CAST(COALESCE(SUM(CASE WHEN is_active THEN ABS(amount) END), 0) AS DOUBLE) AS monthly_total,
       COUNT(*) FILTER (WHERE is_active AND next_due_date < {AS_OF}) AS overdue_count,
       COUNT(*) FILTER (WHERE is_active AND next_due_date <= CAST({AS_OF} + INTERVAL 7 DAY AS DATE)
                        AND next_due_date >= {AS_OF}) AS upcoming_count
FROM v_bills""")
def q_bill_summary(spark, sf):
    return BL.bill_summary(V.bills(spark, sf), V.AS_OF)


@register("bill_payment_summary", """
SELECT COUNT(*) AS payments_count, CAST(COALESCE(SUM(amount_paid), 0) AS DOUBLE) AS total_paid,
       COUNT(DISTINCT recurring_id) AS unique_bills
FROM v_payments WHERE strftime(paid_date, '%Y-%m') = '2001-06'""")
def q_bill_payment_summary(spark, sf):
    return BL.bill_payment_summary(V.payments(spark, sf), 2001, 6)


_HIST_COLS = "id", "recurring_id", "bill_name", "category_name", "paid_date"


@register("payment_history", """
SELECT p.id, p.recurring_id, b.name AS bill_name, c.name AS category_name, p.paid_date,
       CAST(p.amount_paid AS DOUBLE) AS amount_paid
FROM v_payments p LEFT JOIN v_bills b ON p.recurring_id = b.id LEFT JOIN v_categories c ON b.category_id = c.id
WHERE p.paid_date >= DATE '2001-01-01' AND p.paid_date <= DATE '2001-06-30'
ORDER BY p.paid_date DESC, p.id DESC LIMIT 50""")
def q_payment_history(spark, sf):
    h = BL.payment_history(V.payments(spark, sf), V.bills(spark, sf), V.categories(spark),
                           dt.date(2001, 1, 1), dt.date(2001, 6, 30), 50)
    return h.select(*_HIST_COLS, M.out("amount_paid").alias("amount_paid"))


@register("payment_history_per_bill", """
SELECT id, recurring_id, bill_name, category_name, paid_date, amount_paid, rank FROM (
  SELECT p.id, p.recurring_id, b.name AS bill_name, c.name AS category_name, p.paid_date,
         CAST(p.amount_paid AS DOUBLE) AS amount_paid,
         row_number() OVER (PARTITION BY p.recurring_id ORDER BY p.paid_date DESC, p.id DESC) AS rank
  FROM v_payments p LEFT JOIN v_bills b ON p.recurring_id = b.id LEFT JOIN v_categories c ON b.category_id = c.id)
WHERE rank <= 3""")
def q_payment_history_per_bill(spark, sf):
    h = BL.payment_history(V.payments(spark, sf), V.bills(spark, sf), V.categories(spark), limit=3, per_bill=True)
    return h.select(*_HIST_COLS, M.out("amount_paid").alias("amount_paid"), F.col("rank").cast("long"))


def _steps_sql(source: str) -> str:
    """Recursive schedule stepping over ``source`` (id, freq, start); returns (id, next_due)."""
    return f"""
steps(id, freq, d) AS (
  SELECT id, lower(freq), start FROM ({source}) WHERE start IS NOT NULL AND start <= {AS_OF}
  UNION ALL
  SELECT id, freq, CAST(CASE freq WHEN 'daily' THEN d + INTERVAL 1 DAY WHEN 'weekly' THEN d + INTERVAL 7 DAY
        WHEN 'biweekly' THEN d + INTERVAL 14 DAY WHEN 'quarterly' THEN d + INTERVAL 3 MONTH
        WHEN 'yearly' THEN d + INTERVAL 12 MONTH WHEN 'annually' THEN d + INTERVAL 12 MONTH
        ELSE d + INTERVAL 1 MONTH END AS DATE)
  FROM steps WHERE d <= {AS_OF}),
nd AS (SELECT id, MAX(d) AS next_due FROM steps GROUP BY id)"""


@register("next_due_date", f"""
WITH RECURSIVE {_steps_sql("SELECT id, frequency AS freq, start_date AS start FROM v_bills")}
SELECT b.id, b.frequency, b.start_date,
       CASE WHEN b.start_date > {AS_OF} THEN b.start_date ELSE nd.next_due END AS next_due_date
FROM v_bills b LEFT JOIN nd ON b.id = nd.id""")
def q_next_due_date(spark, sf):
    b = V.bills(spark, sf)
    return b.select("id", "frequency", "start_date",
                    next_due_date(F.col("start_date"), F.col("frequency"), V.AS_OF).alias("next_due_date"))


def _paid_feed(spark, sf):
    return V.payments(spark, sf).select("id", "recurring_id", "paid_date",
                    F.when(F.col("id") % 3 == 0, F.lit(None).cast("decimal(18,2)"))
                    .otherwise(F.col("amount_paid")).alias("amount_paid"))


_FEED_SQL = """SELECT id, recurring_id, paid_date, CASE WHEN id % 3 = 0 THEN NULL ELSE amount_paid END AS amount_paid
FROM v_payments"""


@register("bill_mark_paid_payments", f"""
SELECT f.id, f.recurring_id, CAST(COALESCE(f.amount_paid, ABS(b.amount)) AS DOUBLE) AS amount_paid,
       COALESCE(b.next_due_date, f.paid_date) AS due_date, f.paid_date
FROM ({_FEED_SQL}) f JOIN v_bills b ON f.recurring_id = b.id""")
def q_mark_paid_payments(spark, sf):
    _, pay = BL.bill_mark_paid(V.bills(spark, sf), _paid_feed(spark, sf), V.AS_OF)
    return pay.select("id", "recurring_id", M.out("amount_paid").alias("amount_paid"), "due_date", "paid_date")


@register("bill_mark_paid", f"""
WITH RECURSIVE lp AS (SELECT recurring_id AS id, MAX(paid_date) AS last_paid FROM ({_FEED_SQL}) f
                      WHERE recurring_id IN (SELECT id FROM v_bills) GROUP BY recurring_id),
{_steps_sql("SELECT lp.id, b.frequency AS freq, lp.last_paid AS start FROM lp JOIN v_bills b ON lp.id = b.id")}
SELECT b.id, COALESCE(lp.last_paid, b.last_paid_date) AS last_paid_date,
       CASE WHEN lp.last_paid IS NULL THEN b.next_due_date
            WHEN lp.last_paid > {AS_OF} THEN lp.last_paid ELSE nd.next_due END AS next_due_date
FROM v_bills b LEFT JOIN lp ON b.id = lp.id LEFT JOIN nd ON b.id = nd.id""")
def q_mark_paid_bills(spark, sf):
    bills, _ = BL.bill_mark_paid(V.bills(spark, sf), _paid_feed(spark, sf), V.AS_OF)
    return bills.select("id", "last_paid_date", "next_due_date")


@register("bill_reschedule", f"""
WITH RECURSIVE ch AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'quarterly' END AS new_freq,
                             CAST(DATE '2000-01-31' + CAST(id % 3 AS INTEGER) AS DATE) AS new_start
                      FROM v_bills WHERE is_active AND next_due_date < {AS_OF}),
src AS (SELECT b.id, COALESCE(ch.new_freq, b.frequency) AS freq, COALESCE(ch.new_start, b.start_date) AS start,
               ch.id IS NOT NULL AS changed, b.next_due_date FROM v_bills b LEFT JOIN ch ON b.id = ch.id),
{_steps_sql("SELECT id, freq, start FROM src WHERE changed")}
SELECT src.id, src.freq AS frequency, src.start AS start_date,
       CASE WHEN NOT src.changed THEN src.next_due_date WHEN src.start > {AS_OF} THEN src.start ELSE nd.next_due END
         AS next_due_date
FROM src LEFT JOIN nd ON src.id = nd.id""")
def q_bill_reschedule(spark, sf):
    b = V.bills(spark, sf)
    ch = (b.filter(F.col("is_active") & (F.col("next_due_date") < F.lit(V.AS_OF)))
          .select("id", F.when(F.col("id") % 2 == 0, F.lit("quarterly")).alias("frequency"),
                  F.date_add(F.lit(dt.date(2000, 1, 31)), (F.col("id") % 3).cast("int")).alias("start_date")))
    return BL.bill_reschedule(b, ch, V.AS_OF).select("id", "frequency", "start_date", "next_due_date")


# --- goals -------------------------------------------------------------------


@register("goal_progress", """
SELECT g.id, g.name, CAST(g.target_amount AS DOUBLE) AS target_amount,
       COALESCE(a.n, 0) AS contribution_count, CAST(a.s AS DOUBLE) AS total_contributed,
       CAST(COALESCE(a.s, 0) AS DOUBLE) AS current_amount,
       CASE WHEN g.target_amount > 0 THEN CAST(COALESCE(a.s, 0) AS DOUBLE) / CAST(g.target_amount AS DOUBLE) * 100
            ELSE 0.0 END AS progress,
       CASE WHEN g.target_amount > 0
            THEN LEAST(100.0, CAST(FLOOR(CAST(COALESCE(a.s, 0) AS DOUBLE) / CAST(g.target_amount AS DOUBLE) * 100 + 0.5) AS DOUBLE))
            ELSE 0.0 END AS progress_ui
FROM v_goals g LEFT JOIN (SELECT goal_id, COUNT(*) AS n, SUM(amount) AS s FROM v_contributions GROUP BY goal_id) a
  ON a.goal_id = g.id
WHERE g.is_active""")
def q_goal_progress(spark, sf):
    return GO.goal_progress(V.goals(spark, sf), V.contributions(spark, sf))


_GOAL_STATE_SQL = """
SELECT g.id, g.name, CAST(g.target_amount AS DOUBLE) AS target_amount,
       CAST(COALESCE(cur.s, 0) AS DOUBLE) AS current_amount, fc.created_at AS completed_at,
       fc.cid AS completing_contribution_id
FROM v_goals g
LEFT JOIN (SELECT goal_id, SUM(amount) AS s FROM v_contributions GROUP BY goal_id) cur ON cur.goal_id = g.id
LEFT JOIN (SELECT goal_id, arg_min(created_at, (created_at, id)) AS created_at, arg_min(id, (created_at, id)) AS cid
           FROM (SELECT c.*, SUM(c.amount) OVER (PARTITION BY c.goal_id ORDER BY c.created_at, c.id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
                        g2.target_amount
                 FROM v_contributions c JOIN v_goals g2 ON c.goal_id = g2.id) x
           WHERE run >= target_amount GROUP BY goal_id) fc ON fc.goal_id = g.id"""


@register("goal_state", _GOAL_STATE_SQL)
def q_goal_state(spark, sf):
    return GO.goal_state(V.goals(spark, sf), V.contributions(spark, sf))


@register("goal_pace", f"""
SELECT s.id, s.name, g.target_date, CAST(g.target_date - {AS_OF} AS BIGINT) AS days_remaining,
       CASE WHEN g.target_date IS NULL THEN 0.0
            WHEN s.target_amount - s.current_amount <= 0 THEN 0.0
            WHEN g.target_date - {AS_OF} <= 0 THEN s.target_amount - s.current_amount
            ELSE CAST(CEIL((s.target_amount - s.current_amount) / ((g.target_date - {AS_OF}) / 30.0)) AS DOUBLE)
       END AS monthly_needed
FROM ({_GOAL_STATE_SQL}) s JOIN v_goals g ON s.id = g.id""")
def q_goal_pace(spark, sf):
    st = GO.goal_state(V.goals(spark, sf), V.contributions(spark, sf))
    return GO.goal_pace(st, V.goals(spark, sf), V.AS_OF)


_BLEND_SQL = ORACLE_BODY["method_blend_actuals"]


def _blended(spark, sf):
    alloc = BU.method_allocation(templates_df(spark), _incomes(spark, sf))
    return BU.method_blend_actuals(alloc, _spend(spark, sf), category_map_df(spark))


@register("method_totals_by_type", f"""
SELECT owner, type, CAST(SUM(CAST(budget_amount AS DECIMAL(20,2))) AS DOUBLE) AS total FROM ({_ALLOC_SQL}) GROUP BY 1, 2""")
def q_method_totals_by_type(spark, sf):
    return BU.method_totals_by_type(BU.method_allocation(templates_df(spark), _incomes(spark, sf)))


@register("method_allocated_percent", f"""
SELECT b.owner, b.allocated, CASE WHEN i.monthly_income <> 0 THEN CAST(FLOOR(b.allocated / i.monthly_income * 100 + 0.5) AS BIGINT)
       ELSE 0 END AS allocated_percent
FROM (SELECT owner, CAST(SUM(CAST(adjusted_amount AS DECIMAL(20,2))) AS DOUBLE) AS allocated FROM ({_BLEND_SQL}) GROUP BY owner) b
JOIN ({_INCOMES_SQL}) i ON i.owner = b.owner""")
def q_method_allocated_percent(spark, sf):
    return BU.allocation_percent(_blended(spark, sf), _incomes(spark, sf))


@register("method_overrides", f"""
SELECT a.owner, a.name, CASE WHEN a.position % 3 = 0 THEN a.owner * 100.0 ELSE a.budget_amount END AS budget_amount FROM ({_ALLOC_SQL}) a""")
def q_method_overrides(spark, sf):
    alloc = BU.method_allocation(templates_df(spark), _incomes(spark, sf))
    given = alloc.filter(F.col("position") % 3 == 0).select("owner", "name", (F.col("owner") * 100.0).alias("amount"))
    unknown = given.withColumn("name", F.lit("No such category"))
    less = given.withColumn("amount", F.col("amount") - 1)
    return BU.method_overrides(alloc, given.unionByName(unknown).unionByName(less)).select("owner", "name", "budget_amount")


@register("contribution_history", """
SELECT c.id, c.goal_id, g.name AS goal_name, CAST(c.amount AS DOUBLE) AS amount, c.created_at, c.transaction_id, t.merchant,
       t.date AS transaction_date
FROM v_contributions c JOIN v_goals g ON g.id = c.goal_id LEFT JOIN v_ledger t ON t.id = c.transaction_id""")
def q_contribution_history(spark, sf):
    return GO.contribution_history(V.goals(spark, sf), V.contributions(spark, sf), V.ledger(spark, sf))
