"""Registered queries: import normalisation and profiling (§2.1-2.3) over v_raw / v_file_headers."""
from __future__ import annotations

from pyspark.sql import functions as F

from fintally.formats import aliases_df, formats_df
from fintally.functions import money as M
from fintally.functions import normalize as N
from fintally.operators import profile as P
from fintally.plans import views as V
from fintally.plans.registry import register

_S = "trim(raw_date)"
_DATE_SQL = f"""COALESCE(
  CASE WHEN regexp_full_match({_S}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({_S}, '%Y-%m-%d') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({_S}, '%m/%d/%Y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN CAST(try_strptime({_S}, '%m/%d/%y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}') THEN CAST(try_strptime({_S}, '%d-%b-%Y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({_S}, '%d/%m/%Y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN CAST(try_strptime({_S}, '%Y/%m/%d') AS DATE) END,
  CAST(try_strptime({_S}, ['%m/%d/%Y %I:%M %p', '%Y-%m-%dT%H:%M:%SZ', '%b %d %Y', '%m.%d.%Y', '%d.%m.%Y', '%m-%d-%Y', '%d %B %Y',
                           '%Y-%m-%d %H:%M', '%Y%m%d', '%B %d, %Y', '%a, %d %b %Y']) AS DATE))"""

_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def _amount_sql(col: str) -> str:
    t = f"regexp_replace(trim({col}), '[$,]', '', 'g')"
    x = f"trim(CASE WHEN starts_with({t}, '(') AND ends_with({t}, ')') THEN '-' || substr({t}, 2, length({t}) - 2) ELSE {t} END)"
    return f"CASE WHEN regexp_full_match({x}, '{_NUM}') THEN TRY_CAST({x} AS DOUBLE) END"


def _lenient_sql(col: str) -> str:
    c = f"regexp_replace(trim({col}), '[$,]', '', 'g')"
    return f"CASE WHEN {col} IS NULL OR {col} = '' OR {c} = '' OR {c} = '-' THEN 0.0 ELSE {_amount_sql(col)} END"


@register("norm_date", f"SELECT line, raw_date, {_DATE_SQL} AS date FROM v_raw")
def q_norm_date(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", "raw_date", N.norm_date("raw_date").alias("date"))


@register("norm_date_variants", f"""
SELECT line, raw_date, COALESCE(
  CASE WHEN regexp_full_match({_S}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({_S}, '%Y-%m-%d') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({_S}, '%m/%d/%Y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN CAST(try_strptime({_S}, '%m/%d/%y') AS DATE) END,
  CASE WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({_S}, '%d/%m/%Y') AS DATE) END)
  AS date FROM v_raw""")
def q_norm_date_wizard(spark, sf):
    from fintally.formats import WIZARD_DATE_PATTERNS
    r = V.raw_rows(spark, sf)
    return r.select("line", "raw_date", N.norm_date("raw_date", WIZARD_DATE_PATTERNS, fallback=False).alias("date"))


@register("norm_amount", f"SELECT line, raw_amount, {_amount_sql('raw_amount')} AS amount FROM v_raw")
def q_norm_amount(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", "raw_amount", N.norm_amount("raw_amount").alias("amount"))


@register("norm_amount_lenient", f"SELECT line, {_lenient_sql('raw_debit')} AS debit FROM v_raw")
def q_norm_amount_lenient(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", N.norm_amount_lenient("raw_debit").alias("debit"))


@register("norm_split_amount", f"""
SELECT line, CASE WHEN ({_lenient_sql('raw_debit')}) IS NULL AND ({_lenient_sql('raw_credit')}) IS NULL THEN NULL
                  ELSE COALESCE({_lenient_sql('raw_credit')}, 0.0) - COALESCE({_lenient_sql('raw_debit')}, 0.0) END AS amount
FROM v_raw""")
def q_norm_split_amount(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", N.norm_split_amount("raw_debit", "raw_credit").alias("amount"))


@register("norm_split_amount_analysis", f"""
SELECT line, CASE WHEN COALESCE({_amount_sql('raw_credit')}, 0.0) <> 0
                  THEN COALESCE({_amount_sql('raw_credit')}, 0.0) - COALESCE({_amount_sql('raw_debit')}, 0.0)
                  WHEN COALESCE({_amount_sql('raw_debit')}, 0.0) <> 0 THEN -ABS(COALESCE({_amount_sql('raw_debit')}, 0.0))
             END AS amount
FROM v_raw""")
def q_norm_split_amount_analysis(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", N.norm_split_amount_analysis("raw_debit", "raw_credit").alias("amount"))


@register("norm_merchant", "SELECT line, COALESCE(trim(raw_merchant), 'UNKNOWN') AS merchant FROM v_raw")
def q_norm_merchant(spark, sf):
    return V.raw_rows(spark, sf).select("line", N.norm_merchant("raw_merchant").alias("merchant"))


def _raw_rows_map(spark, sf):
    r = V.raw_rows(spark, sf)
    hdr = F.array(*[F.lit(h) for h in ["Date", "Amount", "Merchant", "Description"]])
    vals = F.array("raw_date", "raw_amount", "raw_merchant", "raw_description")
    return r.select("file", F.lit(0).cast("long").alias("blk"), F.col("line").alias("pos"),
                    hdr.alias("header"), vals.alias("values"), F.map_from_arrays(hdr, vals).alias("row"))


def _raw_mapping(spark, sf):
    r = V.raw_rows(spark, sf).select("file").distinct()
    return r.select("file", F.lit("Date").alias("date_column"), F.lit("Amount").alias("amount_column"),
                    F.lit("Merchant").alias("merchant_column"), F.lit("Description").alias("description_column"),
                    F.lit(None).cast("string").alias("debit_column"), F.lit(None).cast("string").alias("credit_column"),
                    F.lit(None).cast("string").alias("balance_column"))


_ROW_SQL = f"""
SELECT file, line, {_DATE_SQL} AS date, {_amount_sql('raw_amount')} AS amount,
       COALESCE(trim(CASE WHEN length(raw_merchant) > 0 THEN raw_merchant END), 'UNKNOWN') AS merchant,
       trim(CASE WHEN length(raw_description) > 0 THEN raw_description END) AS description,
       CASE WHEN raw_date IS NULL OR length(raw_date) = 0 THEN 'missing_date'
            WHEN raw_amount IS NULL OR length(raw_amount) = 0 THEN 'missing_amount'
            WHEN {_DATE_SQL} IS NULL THEN 'bad_date'
            WHEN {_amount_sql('raw_amount')} IS NULL THEN 'bad_amount' ELSE 'ok' END AS status
FROM v_raw"""


@register("norm_row", f"SELECT file, line AS pos, date, amount, merchant, description FROM ({_ROW_SQL}) WHERE status = 'ok'")
def q_norm_row(spark, sf):
    good, _ = P.norm_row(_raw_rows_map(spark, sf), _raw_mapping(spark, sf))
    return good.select("file", "pos", "date", "amount", "merchant", "description")


@register("norm_row_rejected", f"SELECT file, status, COUNT(*) AS n FROM ({_ROW_SQL}) WHERE status <> 'ok' GROUP BY 1, 2")
def q_norm_row_rejected(spark, sf):
    _, bad = P.norm_row(_raw_rows_map(spark, sf), _raw_mapping(spark, sf))
    return bad.groupBy("file", "status").agg(F.count(F.lit(1)).alias("n"))


def _amounts(spark, sf):
    return P.file_amounts(_raw_rows_map(spark, sf), _raw_mapping(spark, sf))


_AMOUNTS_SQL = f"""SELECT file, line, {_amount_sql('raw_amount')} AS amount, lower(trim(raw_merchant)) AS merchant_l,
       {_DATE_SQL} AS date FROM v_raw"""


@register("profile_file_totals", f"""
SELECT file, MIN(date) AS start, MAX(date) AS "end", COUNT(amount) AS transaction_count,
       COUNT(*) FILTER (WHERE amount > 0) AS income_count, COUNT(*) FILTER (WHERE amount < 0) AS expense_count,
       ROUND(COALESCE(SUM(CASE WHEN amount > 0 THEN amount END), 0.0), 2) AS total_income,
       ROUND(COALESCE(SUM(CASE WHEN amount < 0 THEN -amount END), 0.0), 2) AS total_expenses,
       COALESCE(MAX(CASE WHEN amount < 0 THEN -amount END), 0.0) AS largest_expense,
       COALESCE(MAX(CASE WHEN amount > 0 THEN amount END), 0.0) AS largest_income,
       ROUND(SUM(ABS(amount)) / COUNT(amount), 2) AS avg_transaction
FROM ({_AMOUNTS_SQL}) GROUP BY file""")
def q_profile_file_totals(spark, sf):
    t = P.profile_file_totals(_amounts(spark, sf))
    # sums of doubles depend on order: compare them at cent precision
    return t.select("file", "start", "end", "transaction_count", "income_count", "expense_count",
                    M.round_double("total_income", 2).alias("total_income"),
                    M.round_double("total_expenses", 2).alias("total_expenses"),
                    "largest_expense", "largest_income", M.round_double("avg_transaction", 2).alias("avg_transaction"))


_TOP_SQL = f"""
top AS (SELECT file, merchant_l, cnt, row_number() OVER (PARTITION BY file ORDER BY cnt DESC, first_line) AS rank
        FROM (SELECT file, merchant_l, COUNT(*) AS cnt, MIN(line) AS first_line FROM ({_AMOUNTS_SQL})
              WHERE merchant_l IS NOT NULL AND length(merchant_l) > 0 GROUP BY 1, 2))"""


def _title(col: str) -> str:
    # Python's str.title(): the first letter of every run of letters in upper case, the rest lower case
    return (f"array_to_string(list_transform(regexp_extract_all(lower({col}), '\\p{{L}}+|\\P{{L}}+'), "
            "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')")


@register("potential_subscriptions", f"""
WITH {_TOP_SQL}
SELECT file, rank, {_title('merchant_l')} AS merchant FROM top
WHERE rank <= 20 AND cnt >= 2 AND regexp_matches(merchant_l,
  '(?i)(netflix|spotify|hulu|disney\\+|amazon prime|apple\\.com|google\\s*(play|storage|one)|microsoft|adobe|dropbox|youtube premium|hbo\\s*max)')""")
def q_potential_subscriptions(spark, sf):
    s = P.potential_subscriptions(_amounts(spark, sf))
    return s.select("file", F.col("rank").cast("long").alias("rank"), "merchant")


@register("potential_income_sources", f"""
WITH {_TOP_SQL}
SELECT file, rank, {_title('merchant_l')} AS merchant FROM top
WHERE rank <= 20 AND regexp_matches(merchant_l,
  '(?i)(direct deposit|payroll|salary|wages|paycheck|ach credit|interest payment|dividend|refund|tax refund|venmo from|zelle from|transfer from)')""")
def q_potential_income_sources(spark, sf):
    s = P.potential_income_sources(_amounts(spark, sf))
    return s.select("file", F.col("rank").cast("long").alias("rank"), "merchant")


def _keyword_sql(col: str) -> str:
    from fintally.formats import KEYWORD_CATEGORIES
    whens = []
    for cat, kws in KEYWORD_CATEGORIES:
        cond = " OR ".join(f"contains(lower({col}), '{k}')" for k in kws)
        whens.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(whens) + " ELSE 'Other' END"


_KW_COL = "upper(coalesce(raw_merchant, ''))"


@register("keyword_category", f"SELECT line, {_keyword_sql(_KW_COL)} AS category FROM v_raw")
def q_keyword_category(spark, sf):
    r = V.raw_rows(spark, sf)
    return r.select("line", P.keyword_category(F.upper(F.coalesce("raw_merchant", F.lit("")))).alias("category"))


def _onboarding(spark, sf):
    r = V.raw_rows(spark, sf)
    amt = N.onboarding_amount("raw_amount")
    from fintally.formats import ONBOARDING_DATE_PATTERNS
    d = N.norm_date_first_token("raw_date", ONBOARDING_DATE_PATTERNS)
    return (r.select("file", amt.alias("amount"), F.upper(F.coalesce("raw_merchant", F.lit(""))).alias("merchant"),
                     d.alias("date"))
            .filter(F.col("amount").isNotNull() & (F.col("amount") != 0)))


_ONB_SQL = f"""
SELECT file, amount, upper(coalesce(raw_merchant, '')) AS merchant, date FROM (
  SELECT file, raw_merchant,
         CASE WHEN starts_with(t, '(') AND ends_with(t, ')')
              THEN CASE WHEN regexp_full_match(trim(substr(t, 2, length(t) - 2)), '{_NUM}')
                        THEN -TRY_CAST(trim(substr(t, 2, length(t) - 2)) AS DOUBLE) END
              WHEN regexp_full_match(t, '{_NUM}') THEN TRY_CAST(t AS DOUBLE) END AS amount,
         COALESCE(
           CASE WHEN regexp_full_match(tok, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime(tok, '%Y-%m-%d') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime(tok, '%m/%d/%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN CAST(try_strptime(tok, '%m-%d-%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime(tok, '%d/%m/%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN CAST(try_strptime(tok, '%Y/%m/%d') AS DATE) END) AS date
  FROM (SELECT *, trim(regexp_replace(raw_amount, '[$,]', '', 'g')) AS t,
               string_split_regex(trim(raw_date), '\\s+')[1] AS tok FROM v_raw))
WHERE amount IS NOT NULL AND amount <> 0"""


@register("csv_spend_analysis", f"""
SELECT file, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(*) AS total_transactions,
       CASE WHEN MIN(date) IS NULL THEN 1.0 ELSE GREATEST(1.0, (MAX(date) - MIN(date)) / 30.0) END AS months,
       COUNT(*) FILTER (WHERE amount > 0) AS income_count, COUNT(*) FILTER (WHERE amount < 0) AS spending_count
FROM ({_ONB_SQL}) GROUP BY file""")
def q_csv_spend_analysis(spark, sf):
    summary, _ = P.csv_spend_analysis(_onboarding(spark, sf))
    return summary.select("file", "min_date", "max_date", "total_transactions", "months", "income_count",
                          "spending_count")


@register("csv_spend_by_category", f"""
WITH t AS ({_ONB_SQL}),
m AS (SELECT file, CASE WHEN MIN(date) IS NULL THEN 1.0 ELSE GREATEST(1.0, (MAX(date) - MIN(date)) / 30.0) END AS months
      FROM t GROUP BY file)
SELECT t.file, {_keyword_sql('t.merchant')} AS category, ROUND(CAST(SUM(CAST(ABS(t.amount) AS DECIMAL(20,2))) AS DOUBLE) / MAX(m.months), 2) AS monthly
FROM t JOIN m ON t.file = m.file WHERE t.amount < 0 GROUP BY 1, 2""")
def q_csv_spend_by_category(spark, sf):
    _, by_cat = P.csv_spend_analysis(_onboarding(spark, sf))
    return by_cat.select("file", "category", M.round_double("monthly", 2).alias("monthly"))


_FMT_SCORE_SQL = """
fc AS (SELECT format_id, lower(col) AS col, weight, position FROM (
         SELECT format_id, unnest(signature_columns) AS col, 3 AS weight, position FROM fmts
         UNION ALL SELECT format_id, unnest(headers) AS col, 1 AS weight, position FROM fmts) WHERE format_id <> 'generic'),
hs AS (SELECT DISTINCT file, lower(trim("column")) AS h FROM v_file_headers),
m AS (SELECT DISTINCT hs.file, fc.format_id, fc.col, fc.weight FROM hs JOIN fc ON contains(hs.h, fc.col)),
bonus AS (SELECT DISTINCT f.file, x.format_id, 5 AS weight FROM (SELECT DISTINCT file FROM v_file_headers) f
          JOIN fmts x ON x.format_id <> 'generic' AND length(x.institution) > 0
           AND contains(lower(f.file), lower(x.institution))),
sc AS (SELECT file, format_id, SUM(weight) AS score FROM (
         SELECT file, format_id, weight FROM m UNION ALL SELECT file, format_id, weight FROM bonus) GROUP BY 1, 2)"""


def _formats_values_sql():
    from fintally.formats import BANK_FORMATS
    rows = []
    for i, (f, n, inst, at, h, s, m) in enumerate(BANK_FORMATS):
        hs = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in h) + "]"
        ss = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in s) + "]::VARCHAR[]"
        rows.append(f"({i}, '{f}', '{inst}', '{at}', {hs}, {ss})")
    return f"fmts AS (SELECT * FROM (VALUES {', '.join(rows)}) x(position, format_id, institution, account_type, headers, signature_columns))"


@register("detect_format", f"""
WITH {_formats_values_sql()}, {_FMT_SCORE_SQL}
SELECT f.file, COALESCE(b.format_id, 'generic') AS format_id, COALESCE(b.score, 0) AS score
FROM (SELECT DISTINCT file FROM v_file_headers) f LEFT JOIN (
  SELECT file, arg_min(sc.format_id, (-score, x.position)) AS format_id, MAX(score) AS score
  FROM sc JOIN fmts x ON sc.format_id = x.format_id WHERE score > 0 GROUP BY file) b ON f.file = b.file""")
def q_detect_format(spark, sf):
    h = V.file_headers_view(spark, sf)
    names = h.select("file", F.col("file").alias("file_name")).distinct()
    return P.detect_format(h, formats_df(spark), names)


def _aliases_sql():
    from fintally.formats import (AMOUNT_COLUMNS, BALANCE_COLUMNS, CREDIT_COLUMNS, DATE_COLUMNS, DEBIT_COLUMNS,
                                  DESC_COLUMNS, MERCHANT_COLUMNS)
    rows = []
    for field, names in (("date", DATE_COLUMNS), ("amount", AMOUNT_COLUMNS), ("debit", DEBIT_COLUMNS),
                         ("credit", CREDIT_COLUMNS), ("merchant", MERCHANT_COLUMNS),
                         ("description", DESC_COLUMNS), ("balance", BALANCE_COLUMNS)):
        rows += [f"('{field}', '{a}', {r})" for r, a in enumerate(names)]
    return f"al AS (SELECT * FROM (VALUES {', '.join(rows)}) x(field, alias, rank))"


@register("detect_columns_by_name", f"""
WITH {_aliases_sql()},
lc AS (SELECT file, lower("column") AS alias, arg_max("column", position) AS "column" FROM v_file_headers GROUP BY 1, 2),
c AS (SELECT lc.file, al.field, lc."column", al.rank FROM lc JOIN al ON lc.alias = al.alias
      WHERE al.field IN ('date', 'amount', 'merchant', 'description')),
f1 AS (SELECT file, field, arg_min("column", rank) AS "column" FROM c WHERE field <> 'description' GROUP BY 1, 2),
mm AS (SELECT file, "column" AS m FROM f1 WHERE field = 'merchant')
SELECT file, field, "column" FROM f1
UNION ALL
SELECT c.file, c.field, arg_min(c."column", c.rank) FROM c LEFT JOIN mm ON c.file = mm.file
WHERE c.field = 'description' AND (mm.m IS NULL OR c."column" <> mm.m) GROUP BY 1, 2""")
def q_detect_columns_by_name(spark, sf):
    return P.detect_columns_by_name(V.file_headers_view(spark, sf), aliases_df(spark))


@register("detect_split_amounts", """
SELECT file,
       (MAX(CASE WHEN lower("column") IN ('debit', 'debited', 'withdrawals', 'outflow') THEN 1 ELSE 0 END)
        + MAX(CASE WHEN lower("column") IN ('credit', 'credited', 'deposits', 'inflow') THEN 1 ELSE 0 END)) = 2 AS detected,
       arg_min(CASE WHEN contains(lower("column"), 'debit') OR contains(lower("column"), 'withdraw')
                     OR contains(lower("column"), 'outflow') THEN "column" END,
               CASE WHEN contains(lower("column"), 'debit') OR contains(lower("column"), 'withdraw')
                     OR contains(lower("column"), 'outflow') THEN position END) AS debit_column,
       arg_min(CASE WHEN contains(lower("column"), 'credit') OR contains(lower("column"), 'deposit')
                     OR contains(lower("column"), 'inflow') THEN "column" END,
               CASE WHEN contains(lower("column"), 'credit') OR contains(lower("column"), 'deposit')
                     OR contains(lower("column"), 'inflow') THEN position END) AS credit_column
FROM v_file_headers GROUP BY file""")
def q_detect_split_amounts(spark, sf):
    return P.detect_split_amounts(V.file_headers_view(spark, sf))


_ACCT_FORMATS = ["chase_credit", "pnc", "generic", "marcus"]


@register("detect_account_type", f"""
WITH st AS (SELECT file, COUNT(amount) AS total, COUNT(*) FILTER (WHERE amount > 0) AS pos,
                   COUNT(*) FILTER (WHERE amount < 0) AS neg,
                   COUNT(*) FILTER (WHERE regexp_matches(merchant_l, 'payment|thank you')) AS payments,
                   COUNT(*) FILTER (WHERE regexp_matches(merchant_l, 'direct dep|payroll|salary')) AS payroll
            FROM ({_AMOUNTS_SQL}) GROUP BY file),
ff AS (SELECT file, [{", ".join(repr(x) for x in _ACCT_FORMATS)}][CAST(regexp_extract(file, 'acct_([0-9]+)', 1) AS INTEGER) % 4 + 1]
              AS format_id FROM st),
ft AS (SELECT * FROM (VALUES ('chase_credit', 'credit_card', 'Chase Credit Card'), ('pnc', 'checking', 'PNC Bank'),
                             ('generic', 'unknown', 'Generic Format'), ('marcus', 'savings', 'Marcus by Goldman Sachs'))
       x(format_id, fmt_type, fmt_name)),
j AS (SELECT st.*, ft.fmt_type, ft.fmt_name, st.total > 0 AS has_amounts,
             st.neg > st.total * 0.7 AS credit,
             NOT (st.neg > st.total * 0.7) AND st.pos > st.total * 0.1 AND st.neg > st.total * 0.3 AS checking,
             NOT (st.neg > st.total * 0.7) AND NOT (st.pos > st.total * 0.1 AND st.neg > st.total * 0.3)
               AND st.pos > st.total * 0.5 AS savings
      FROM st JOIN ff ON st.file = ff.file JOIN ft ON ff.format_id = ft.format_id),
k AS (SELECT *, CASE WHEN has_amounts AND credit THEN 'credit_card' WHEN has_amounts AND checking THEN 'checking'
                     WHEN has_amounts AND savings THEN 'savings' ELSE fmt_type END AS t0,
                CASE WHEN has_amounts AND credit THEN CASE WHEN payments >= 1 THEN 'high' ELSE 'medium' END
                     WHEN has_amounts AND checking THEN CASE WHEN payroll >= 1 THEN 'high' ELSE 'medium' END
                     WHEN has_amounts AND savings THEN 'medium' ELSE 'low' END AS c0,
                has_amounts AND fmt_type IN ('credit_card', 'checking', 'savings') AS override
      FROM j)
SELECT file, CASE WHEN override THEN fmt_type ELSE t0 END AS type,
       CASE WHEN override AND c0 = 'low' THEN 'medium' ELSE c0 END AS confidence,
       array_to_string(list_filter([
         CASE WHEN has_amounts AND credit THEN 'Mostly expenses (typical for credit card)' END,
         CASE WHEN has_amounts AND credit AND payments >= 1 THEN 'Found payment transactions' END,
         CASE WHEN has_amounts AND checking AND payroll >= 1 THEN 'Found direct deposit transactions' END,
         CASE WHEN has_amounts AND checking AND payroll < 1 THEN 'Mix of income and expenses' END,
         CASE WHEN has_amounts AND savings THEN 'Mostly deposits' END,
         CASE WHEN override THEN 'Format signature: ' || fmt_name END], lambda x: x IS NOT NULL), '; ') AS hints
FROM k""")
def q_detect_account_type(spark, sf):
    amounts = _amounts(spark, sf)
    files = V.raw_rows(spark, sf).select("file").distinct()
    idx = F.regexp_extract("file", r"acct_([0-9]+)", 1).cast("int") % 4 + 1
    ff = files.select("file", F.element_at(F.array(*[F.lit(x) for x in _ACCT_FORMATS]), idx).alias("format_id"))
    return P.detect_account_type(amounts, ff, formats_df(spark), _raw_mapping(spark, sf))


@register("norm_onboarding_row", f"""
SELECT file, pos, amount, trim(coalesce(raw_merchant, '')) AS merchant,
       substr(trim(coalesce(raw_merchant, '')), 1, 100) AS description,
       COALESCE(strftime(date, '%Y-%m-%d'), trim(coalesce(raw_date, ''))) AS date_text
FROM (
  SELECT file, line AS pos, raw_merchant, raw_date,
         CASE WHEN starts_with(t, '(') AND ends_with(t, ')')
              THEN CASE WHEN regexp_full_match(trim(substr(t, 2, length(t) - 2)), '{_NUM}')
                        THEN -TRY_CAST(trim(substr(t, 2, length(t) - 2)) AS DOUBLE) END
              WHEN regexp_full_match(t, '{_NUM}') THEN TRY_CAST(t AS DOUBLE) END AS amount,
         COALESCE(
           CASE WHEN regexp_full_match(tok, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime(tok, '%Y-%m-%d') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime(tok, '%m/%d/%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN CAST(try_strptime(tok, '%m-%d-%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime(tok, '%d/%m/%Y') AS DATE) END,
           CASE WHEN regexp_full_match(tok, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN CAST(try_strptime(tok, '%Y/%m/%d') AS DATE) END) AS date
  FROM (SELECT *, trim(regexp_replace(raw_amount, '[$,]', '', 'g')) AS t,
               string_split_regex(trim(raw_date), '\\s+')[1] AS tok FROM v_raw))
WHERE amount IS NOT NULL AND amount <> 0""")
def q_norm_onboarding_row(spark, sf):
    mapping = _raw_mapping(spark, sf).withColumn("description_column", F.lit("Merchant"))
    good, _ = P.norm_onboarding_row(_raw_rows_map(spark, sf), mapping)
    return good.select("file", "pos", "amount", "merchant", "description", "date_text")
