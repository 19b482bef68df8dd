"""DuckDB spelling of the derived views in ``views.py`` (the oracle side).

``with_views(sql)`` prefixes a query with the CTEs it needs. The oracle is an independent
statement of the same result; it is only used for checking, never by the library.
"""
from __future__ import annotations

from fintally.plans import views as V
from fintally.schema import DEFAULT_CATEGORIES


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_CATS = _values([(i + 1, n, V.CATEGORY_KEYWORDS[i], V.CATEGORY_BUDGETS[i])
                 for i, n in enumerate(DEFAULT_CATEGORIES)])
_RULES = _values(V.TEST_RULES)
_SETTINGS = _values(V.TEST_SETTINGS)
_FREQS = ", ".join(f"'{f}'" for f in V.BILL_FREQUENCIES)
_STEPS = ", ".join(str(s) for s in V.RECURRING_STEPS)
from fintally.formats import BANK_FORMATS  # noqa: E402

_FMT_ROWS = [(i, f[2].lower().replace(" ", "_"), f[4]) for i, f in enumerate(BANK_FORMATS)]
_FORMATS = ", ".join(f"({i}, '{inst}', [{', '.join(repr(h) for h in hs)}])" for i, inst, hs in _FMT_ROWS)
AS_OF = f"DATE '{V.AS_OF.isoformat()}'"
AS_OF_TS = f"TIMESTAMP '{V.AS_OF_TS.isoformat(sep=' ')}'"

VIEW_SQL = {
    "v_ledger": """
SELECT o.o_orderkey AS id,
       CAST(o.o_orderdate AS DATE) AS date,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2))
            * (CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE -1 END)
            * (CASE WHEN o.o_orderkey % 97 = 0 THEN 10 ELSE 1 END) AS DECIMAL(18,2)) AS amount,
       CASE WHEN o.o_orderkey % 101 = 0 THEN 'ONEOFF-' || CAST(o.o_orderkey AS VARCHAR)
            ELSE c.c_name END AS merchant,
       o.o_orderpriority AS description,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_custkey % 14 + 1 END AS category_id,
       CAST(c.c_nationkey AS BIGINT) AS account_id,
       FALSE AS is_recurring,
       (o.o_orderkey % 97 = 0) AS is_anomaly,
       (o.o_orderkey % 50 = 1) AS is_split,
       CAST(o.o_orderdate AS TIMESTAMP) AS created_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_categories": f"""
SELECT CAST(id AS BIGINT) AS id, name,
       CASE WHEN kw = '' THEN [] ELSE string_split(kw, ',') END AS keywords,
       CAST(budget AS DECIMAL(18,2)) AS budget_amount
FROM (VALUES {_CATS}) t(id, name, kw, budget)""",
    "v_accounts": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
       'Bank ' || CAST(n_regionkey AS VARCHAR) AS institution,
       ['checking', 'savings', 'credit', 'investment'][n_nationkey % 4 + 1] AS account_type,
       CAST(CAST(1000 * n_nationkey AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS initial_balance,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE DATE '1998-01-01' END AS balance_as_of_date,
       (n_nationkey % 10 <> 9) AS is_active
FROM nation""",
    "v_bills": f"""
SELECT c_custkey AS id, 'Bill ' || c_name AS name, c_name AS merchant,
       CAST(-ABS(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount,
       [{_FREQS}][c_custkey % 8 + 1] AS frequency,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 14 + 1 END AS category_id,
       CAST(c_nationkey AS BIGINT) AS account_id,
       CAST(DATE '2001-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS start_date,
       CAST({AS_OF} + CAST(c_custkey % 41 - 10 AS INTEGER) AS DATE) AS next_due_date,
       CAST(NULL AS DATE) AS last_paid_date,
       (c_custkey % 7 <> 0) AS is_active
FROM customer""",
    "v_payments": """
SELECT o_orderkey AS id, o_custkey AS recurring_id,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount_paid,
       CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 5 AS INTEGER) AS DATE) AS due_date,
       CAST(o_orderdate AS DATE) AS paid_date,
       o_orderkey AS transaction_id
FROM orders""",
    "v_splits": """
SELECT id * 10 + 1 AS id, id AS transaction_id, id % 14 + 1 AS category_id,
       CAST(CAST((cents * 6) // 10 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS amount, 'part 1' AS description
FROM (SELECT id, CAST(ABS(amount) * 100 AS BIGINT) AS cents FROM v_ledger WHERE is_split) p
UNION ALL
SELECT id * 10 + 2 AS id, id AS transaction_id, (id + 5) % 14 + 1 AS category_id,
       CAST(CAST(cents - (cents * 6) // 10 + (CASE WHEN (id // 50) % 7 = 0 THEN 2 ELSE 0 END)
                 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS amount, 'part 2' AS description
FROM (SELECT id, CAST(ABS(amount) * 100 AS BIGINT) AS cents FROM v_ledger WHERE is_split) p""",
    "v_goals": """
SELECT s_suppkey AS id, s_name AS name,
       CASE WHEN s_suppkey % 13 = 0 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(ABS(CAST(s_acctbal AS DECIMAL(18,2))) * 100 AS DECIMAL(18,2)) END AS target_amount,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL
            ELSE CAST(DATE '2001-06-01' + CAST(s_suppkey * 7 % 200 AS INTEGER) AS DATE) END AS target_date,
       (s_suppkey % 11 <> 10) AS is_active
FROM supplier""",
    "v_contributions": """
SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS goal_id,
       CAST(CAST((CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) // 100) AS DECIMAL(18,2)) / 100
            * (CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE -1 END) AS DECIMAL(18,2)) AS amount,
       o_orderkey AS transaction_id,
       CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders""",
    "v_recurring": f"""
SELECT c_custkey * 10 + i AS id,
       CAST(DATE '2024-01-01' + CAST(c_custkey % 28 + i * [{_STEPS}][c_custkey % 6 + 1]
                                     + (c_custkey * i) % 3 AS INTEGER) AS DATE) AS date,
       CAST(-ABS(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount,
       c_name AS merchant,
       CAST(NULL AS VARCHAR) AS description,
       c_custkey % 14 + 1 AS category_id,
       CAST(c_nationkey AS BIGINT) AS account_id
FROM (SELECT *, unnest(range(0, 5)) AS i FROM customer)""",
    "v_rules": f"""
SELECT CAST(id AS BIGINT) AS id, name, rule_type, pattern, CAST(category_id AS BIGINT) AS category_id,
       CAST(priority AS BIGINT) AS priority, is_active,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(m AS BIGINT)) AS created_at
FROM (VALUES {_RULES}) t(id, name, rule_type, pattern, category_id, priority, is_active, m)""",
    "v_settings": f"SELECT key, value FROM (VALUES {_SETTINGS}) t(key, value)",
    "v_part_rules": """
SELECT p_partkey AS id, 'Rule ' || CAST(p_partkey AS VARCHAR) AS name,
       ['merchant_contains', 'merchant_exact', 'description_contains', 'amount_range'][p_partkey % 4 + 1] AS rule_type,
       CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) || '00' ELSE p_name END AS pattern,
       p_partkey % 17 + 1 AS category_id, CAST(p_size AS BIGINT) AS priority, p_partkey % 7 <> 0 AS is_active
FROM part""",
    "v_supplier_categories": """
SELECT s_suppkey AS id, s_name AS name, CAST(s_acctbal AS DECIMAL(18,2)) AS budget_amount FROM supplier""",
    "v_customer_settings": """
SELECT c_name AS key, CASE c_custkey % 3 WHEN 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)
       WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS value FROM customer""",
    "v_template": """
SELECT COALESCE(s_name, p_name || ' ' || CAST(p_partkey AS VARCHAR)) AS name, p_type AS keywords, p_retailprice AS budget_amount,
       p_partkey AS position FROM part LEFT JOIN supplier ON s_suppkey * 3 = p_partkey""",
    "v_vectors": """
SELECT vec_id AS transaction_id, embedding AS vector,
       'Merchant ' || CAST(vec_id % 37 AS VARCHAR) AS merchant,
       ['Shopping', 'food & dining'][label % 2 + 1] AS category,
       vec_id * 1.25 AS amount
FROM embeddings""",
    "v_log": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS transaction_id, l_partkey % 14 + 1 AS category_id,
       l_discount AS confidence, l_returnflag AS explanation, CAST(l_shipdate AS TIMESTAMP) AS created_at
FROM lineitem""",
    "v_batch": """
SELECT 'export_' || CAST(l.l_linenumber AS VARCHAR) AS file, l.l_orderkey AS line, t.date, t.amount, t.merchant,
       t.description
FROM lineitem l JOIN v_ledger t ON l.l_orderkey = t.id""",
    "v_existing": "SELECT * FROM v_ledger WHERE date < DATE '1998-01-01'",
    "v_changes": """
SELECT l_orderkey AS id,
       CASE WHEN l_linenumber = 7 THEN '__delete__'
            ELSE ['category_id', 'account_id', 'description', 'merchant'][l_linenumber % 4 + 1] END AS field,
       CASE WHEN l_linenumber % 4 = 2 THEN l_returnflag || l_linestatus ELSE CAST(l_partkey % 20 AS VARCHAR) END AS value,
       l_suppkey % 5 AS seq
FROM lineitem""",
    "v_raw": f"""
SELECT 'acct_' || CAST(o.o_custkey // 20 AS VARCHAR) || '.csv' AS file, o.o_orderkey AS line,
       CASE WHEN o.o_orderkey % 13 = 3 THEN [strftime(CAST(o.o_orderdate AS DATE), '%m/%d/%Y') || ' 10:30 AM',
              strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') || 'T10:00:00Z', strftime(CAST(o.o_orderdate AS DATE), '%b %d %Y'),
              strftime(CAST(o.o_orderdate AS DATE), '%d.%m.%Y'), strftime(CAST(o.o_orderdate AS DATE), '%m-%d-%Y'),
              strftime(CAST(o.o_orderdate AS DATE), '%d %B %Y'), strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') || ' 23:59',
              strftime(CAST(o.o_orderdate AS DATE), '%Y%m%d'), strftime(CAST(o.o_orderdate AS DATE), '%B %-d, %Y'),
              strftime(CAST(o.o_orderdate AS DATE), '%a, %d %b %Y')][(o.o_orderkey // 13) % 10 + 1]
            ELSE CASE o.o_orderkey % 6 WHEN 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d')
            WHEN 1 THEN strftime(CAST(o.o_orderdate AS DATE), '%m/%d/%Y')
            WHEN 2 THEN strftime(CAST(o.o_orderdate AS DATE), '%m/%d/%y')
            WHEN 3 THEN strftime(CAST(o.o_orderdate AS DATE), '%d-%b-%Y')
            WHEN 4 THEN strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y')
            ELSE CASE WHEN o.o_orderkey % 60 = 5 THEN 'not a date'
                      ELSE strftime(CAST(o.o_orderdate AS DATE), '%Y/%m/%d') END END END AS raw_date,
       CASE o.o_orderkey % 5 WHEN 0 THEN CAST(v AS VARCHAR)
            WHEN 1 THEN '$' || format('{{:,.2f}}', v)
            WHEN 2 THEN CASE WHEN v < 0 THEN '(' || CAST(CAST(-v AS DECIMAL(18,2)) AS VARCHAR) || ')' ELSE CAST(v AS VARCHAR) END
            WHEN 3 THEN ' ' || CAST(v AS VARCHAR) || ' '
            ELSE CASE WHEN o.o_orderkey % 50 = 4 THEN 'n/a' ELSE format('{{:,.2f}}', v) END END AS raw_amount,
       CASE WHEN o.o_orderkey % 41 = 0 THEN NULL
            WHEN o.o_custkey % 9 = 8 THEN c.c_name
            WHEN o.o_custkey % 9 = 4 THEN 'Kroger #' || CAST(o.o_custkey AS VARCHAR)
            WHEN o.o_custkey % 9 = 5 THEN 'Shell Oil ' || CAST(o.o_custkey AS VARCHAR)
            ELSE [{", ".join("'" + m + "'" for m in V.RAW_MERCHANTS)}][o.o_custkey % 9 + 1] END AS raw_merchant,
       o.o_orderpriority AS raw_description,
       CASE WHEN v < 0 THEN CAST(CAST(-v AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END AS raw_debit,
       CASE WHEN v > 0 THEN CAST(v AS VARCHAR) ELSE '' END AS raw_credit
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END)
                     AS DECIMAL(18,2)) AS v FROM orders) o
JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_file_headers": f"""
SELECT 'export_' || CAST(c_custkey AS VARCHAR)
       || CASE WHEN c_custkey % 3 = 0 THEN '_' || f.inst ELSE '' END || '.csv' AS file,
       CAST(generate_subscripts(f.headers, 1) - 1 AS INTEGER) AS position, unnest(f.headers) AS "column"
FROM customer JOIN (VALUES {_FORMATS}) f(idx, inst, headers) ON c_custkey % {len(_FMT_ROWS)} = f.idx""",
}

# Dependencies between views (CTE order matters).
_DEPS = {"v_splits": ["v_ledger"], "v_batch": ["v_ledger"], "v_existing": ["v_ledger"]}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every view it mentions (and their dependencies)."""
    needed: list[str] = []

    def need(name):
        for d in _DEPS.get(name, []):
            need(d)
        if name not in needed:
            needed.append(name)

    for name in VIEW_SQL:
        if name in sql:
            need(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
