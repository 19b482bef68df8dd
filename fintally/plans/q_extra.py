"""Registered queries: file sources and sinks, the join shapes by name, remaining budget and
dedupe functions, and the streaming variants run to completion (availableNow)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fintally.formats import aliases_df, formats_df
from fintally.functions import money as M
from fintally.functions.schedule import income_monthly_equivalent
from fintally.operators import accounts as AC
from fintally.operators import analytics as A
from fintally.operators import budget as BU
from fintally.operators import changes as CH
from fintally.operators import profile as P
from fintally.plans import q_analytics, q_changes, q_detect, q_import, q_ledger, q_similarity  # noqa: F401  (aliases below)
from fintally.plans import views as V
from fintally.plans.exports import export_name, write_exports
from fintally.plans.registry import ORACLE, QUERIES, register
from fintally.session import scratch_dir, written
from fintally.sources import ledger_io as IO
from fintally.sources.csv_exports import src_csv_exports, src_csv_headers, src_sample_rows, stored_lines
from fintally.streaming import ledger_streams as ST

# --- join shapes, exercised through the operators that use them --------------------

_JOIN_ALIASES = {
    "join_left_dims": "active_bills",
    "join_inner_rules": "active_rules",
    "join_left_on_predicate": "category_totals",
    "join_scalar_subquery": "goal_progress",
    "join_anti_dedupe": "ledger_dedupe",
    "join_theta_rules": "rules_match",
    "join_asof_balance": "account_balance_asof",
    "join_knn": "knn_exact",
}
for _name, _src in _JOIN_ALIASES.items():
    QUERIES[_name] = QUERIES[_src]
    if _src in ORACLE:
        ORACLE[_name] = ORACLE[_src]


# --- sources and sinks over files derived from the tables --------------------------

_CSV_HEADER = """CASE WHEN regexp_matches(file, '[13579].csv$') THEN 'Date,Amount,Merchant,Description,Description.1,Unnamed: 5'
            ELSE 'Date,Amount,Merchant,Description' END AS header"""
_CSV_FIELDS = f"""
SELECT file AS export, raw_date AS date, raw_amount AS amount, COALESCE(raw_merchant, '') AS merchant,
       CASE WHEN line % 31 = 0 THEN NULL WHEN line % 29 = 0 THEN raw_description || chr(10) || 'second, "line"'
            WHEN line % 17 = 0 THEN raw_description || ' 5" pipe' ELSE raw_description END AS description,
       {_CSV_HEADER} FROM v_raw"""
# the last line of every third file, whose quote never closes, is read as it stands
_CSV_OPEN = f"""
SELECT DISTINCT file AS export, '1992-01-01' AS date, '-1.00' AS amount, 'Left Open' AS merchant, '"never' AS description,
       {_CSV_HEADER} FROM v_raw WHERE regexp_matches(file, '[0369].csv$')"""


def _csv_fields(rows):
    field = lambda c: F.col("row")[c]
    return rows.select(export_name().alias("export"), field("Date").alias("date"), field("Amount").alias("amount"), field("Merchant").alias("merchant"),
                       field("Description").alias("description"), F.array_join("header", ",").alias("header"))


@register("src_csv_exports", f"""
{_CSV_FIELDS} UNION ALL {_CSV_OPEN}
UNION ALL SELECT export, '', '', '', '', header FROM ({_CSV_FIELDS.replace("FROM v_raw", "FROM v_raw WHERE line % 53 = 0")})""")
def q_src_csv_exports(spark, sf):
    return _csv_fields(src_csv_exports(spark, write_exports(spark, sf, awkward=True), clean=False))


@register("src_clean_rows", f"{_CSV_FIELDS} UNION ALL {_CSV_OPEN}")
def q_src_clean_rows(spark, sf):
    return _csv_fields(src_csv_exports(spark, write_exports(spark, sf, awkward=True), clean=True))


def _import(spark, sf):
    """The exports, imported into a ledger that already holds the rows of even line numbers."""
    from fintally.functions.normalize import norm_amount, norm_date, norm_merchant
    from fintally.plans.importer import import_job
    raw = V.raw_rows(spark, sf).filter(F.col("line") % 2 == 0)
    had = raw.select(norm_date(F.col("raw_date")).alias("date"), norm_amount(F.col("raw_amount")).cast("decimal(18,2)").alias("amount"), norm_merchant(F.col("raw_merchant")).alias("merchant"))
    return import_job(spark, write_exports(spark, sf), had.dropna(subset=["date", "amount"]), V.rules(spark), V.categories(spark))


_IMPORT_SQL = f"""
WITH all_rows AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS n FROM (SELECT r.*, (r.line % 2 = 0) AS had FROM ({q_import._ROW_SQL}) r)),
good AS (SELECT file, line, n, had, date, CAST(amount AS DECIMAL(18,2)) AS amount, merchant, description FROM all_rows WHERE status = 'ok'),
fresh AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h WHERE h.had AND h.date = g.date AND h.amount = g.amount AND h.merchant = g.merchant)),
newrows AS (SELECT row_number() OVER () AS id, * FROM (SELECT arg_min(file, (file, line)) AS file, date, amount, merchant, arg_min(coalesce(description, chr(0)), (file, line)) AS d
            FROM fresh GROUP BY date, amount, merchant)),
newrow AS (SELECT id, file, date, amount, merchant, CASE WHEN d <> chr(0) THEN d END AS description FROM newrows),
{q_changes._RULES_RANKED.replace("v_ledger t", "newrow t")},
bad AS (SELECT file, n, CASE WHEN status = 'bad_amount' OR status = 'bad_date' AND amount IS NULL THEN 'Row ' || n || ': Invalid amount'
                             WHEN status = 'bad_date' THEN 'Row ' || n || ': Invalid date format' END AS error FROM all_rows WHERE status <> 'ok')"""


@register("import_job", f"""{_IMPORT_SQL},
p AS (SELECT file, COUNT(*) AS parsed FROM good GROUP BY file),
a AS (SELECT file, COUNT(*) AS added, COUNT(rr.category_id) FILTER (WHERE rr.category_id <> 0) AS by_rule
      FROM newrow LEFT JOIN best ON best.id = newrow.id LEFT JOIN rr ON rr.rk = best.rk GROUP BY file),
e AS (SELECT file, COUNT(*) FILTER (WHERE error IS NULL) AS skipped, COUNT(error) AS total_errors,
             array_to_string(list(error ORDER BY n) FILTER (WHERE error IS NOT NULL)[:10], '; ') AS first_errors FROM bad GROUP BY file)
SELECT f.file AS export, COALESCE(parsed, 0) AS parsed, COALESCE(skipped, 0) AS skipped, COALESCE(total_errors, 0) AS total_errors, COALESCE(first_errors, '') AS first_errors,
       COALESCE(added, 0) AS added, COALESCE(parsed, 0) - COALESCE(added, 0) AS duplicates, COALESCE(by_rule, 0) AS by_rule
FROM (SELECT DISTINCT file FROM v_raw) f LEFT JOIN p USING (file) LEFT JOIN a USING (file) LEFT JOIN e USING (file)""")
def q_import_job(spark, sf):
    """The report of an import from files to categorised rows."""
    rep = _import(spark, sf).report
    return rep.select(export_name().alias("export"), "parsed", "skipped", "total_errors", F.array_join("first_errors", "; ").alias("first_errors"),
                      "added", "duplicates", F.col("rule").alias("by_rule"))


@register("src_sample_rows", """
SELECT file AS export, sample_no, raw_date, raw_amount, COALESCE(raw_merchant, '') AS raw_merchant, raw_description FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS sample_no FROM v_raw)
WHERE sample_no <= 5""")
def q_src_sample_rows(spark, sf):
    rows = src_csv_exports(spark, write_exports(spark, sf))
    s = src_sample_rows(rows, 5)
    return s.select(export_name().alias("export"), F.col("sample_no").cast("long").alias("sample_no"),
                    *[F.col("row")[c].alias(f"raw_{c.lower()}") for c in ("Date", "Amount", "Merchant", "Description")])


def _export_profile(spark, sf):
    path = write_exports(spark, sf)
    lines = stored_lines(spark, path)
    rows = written(src_csv_exports(spark, path, lines=lines), "export-rows")
    headers = written(src_csv_headers(spark, path, lines), "export-headers")
    prof = written(P.column_profiles(P.cells(rows)), "export-profiles")
    return rows, headers, prof


def _profiles_sql() -> str:
    from fintally.plans import q_import as QI
    date_v = QI._DATE_SQL.replace("raw_date", "value")
    amt_v = QI._amount_sql("value")
    return f"""
cells AS (SELECT file, line, 0 AS position, 'Date' AS col, raw_date AS value FROM v_raw
          UNION ALL SELECT file, line, 1, 'Amount', raw_amount FROM v_raw
          UNION ALL SELECT file, line, 2, 'Merchant', raw_merchant FROM v_raw
          UNION ALL SELECT file, line, 3, 'Description', raw_description FROM v_raw),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, position ORDER BY line) AS k
                       FROM cells WHERE value IS NOT NULL AND length(value) > 0) WHERE k <= 20),
prof AS (SELECT file, position, col, COUNT(*) FILTER (WHERE k <= 10) AS n10,
                COUNT(*) FILTER (WHERE k <= 10 AND ({date_v}) IS NOT NULL) AS dates10, COUNT(*) AS n20,
                COUNT(*) FILTER (WHERE ({amt_v}) IS NOT NULL) AS nums20,
                COUNT(DISTINCT value) AS distinct20, AVG(length(value)) AS avglen20
         FROM top GROUP BY 1, 2, 3)"""


def _detect_columns_sql() -> str:
    from fintally.formats import BANK_FORMATS
    from fintally.plans import q_import as QI

    def q(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    maps = ", ".join(f"('{f}', {', '.join(q(x) for x in m)})" for f, _n, _i, _a, _h, _s, m in BANK_FORMATS)
    return f"""
WITH {QI._formats_values_sql()},
hdr AS (SELECT f.file, h.position, h."column" FROM (SELECT DISTINCT file FROM v_raw) f,
        (VALUES (0, 'Date'), (1, 'Amount'), (2, 'Merchant'), (3, 'Description')) h(position, "column")),
{QI._FMT_SCORE_SQL.replace("v_file_headers", "hdr")},
det AS (SELECT f.file, COALESCE(b.format_id, 'generic') AS format_id FROM (SELECT DISTINCT file FROM hdr) f
        LEFT JOIN (SELECT file, arg_min(sc.format_id, (-score, x.position)) AS format_id
                   FROM sc JOIN fmts x ON sc.format_id = x.format_id WHERE score > 0 GROUP BY file) b ON f.file = b.file),
mp AS (SELECT * FROM (VALUES {maps}) m(format_id, map_date, map_merchant, map_amount, map_description, map_debit, map_credit)),
fm AS (SELECT d.file,
              CASE WHEN mp.map_date IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_date END AS map_date,
              CASE WHEN mp.map_merchant IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_merchant END AS map_merchant,
              CASE WHEN mp.map_amount IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_amount END AS map_amount,
              CASE WHEN mp.map_description IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_description END AS map_description,
              CASE WHEN mp.map_debit IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_debit END AS map_debit,
              CASE WHEN mp.map_credit IN (SELECT "column" FROM hdr h WHERE h.file = d.file) THEN mp.map_credit END AS map_credit
       FROM det d LEFT JOIN mp ON d.format_id = mp.format_id),
{QI._aliases_sql()},
bn AS (SELECT lc.file, al.field, lc."column", al.rank FROM (
         SELECT file, lower("column") AS alias, arg_max("column", position) AS "column" FROM hdr GROUP BY 1, 2) lc
       JOIN al ON lc.alias = al.alias),
nm AS (SELECT file, field, arg_min("column", rank) AS "column" FROM bn GROUP BY 1, 2),
{_profiles_sql()},
pdate AS (SELECT file, arg_min(col, position) AS c FROM prof WHERE n10 > 0 AND dates10 >= n10 * 0.7 GROUP BY file),
pamt AS (SELECT file, arg_min(col, position) AS c FROM prof WHERE n20 > 0 AND nums20 >= n20 * 0.8
         AND NOT contains(lower(col), 'balance') AND NOT contains(lower(col), 'running') GROUP BY file),
j AS (SELECT fm.*, (SELECT "column" FROM nm WHERE nm.file = fm.file AND field = 'date') AS n_date,
             (SELECT "column" FROM nm WHERE nm.file = fm.file AND field = 'amount') AS n_amount,
             (SELECT "column" FROM nm WHERE nm.file = fm.file AND field = 'debit') AS n_debit,
             (SELECT "column" FROM nm WHERE nm.file = fm.file AND field = 'credit') AS n_credit,
             (SELECT c FROM pdate WHERE pdate.file = fm.file) AS p_date,
             (SELECT c FROM pamt WHERE pamt.file = fm.file) AS p_amount
      FROM fm),
s1 AS (SELECT file, COALESCE(map_date, n_date, p_date) AS date_column,
              CASE WHEN map_amount IS NULL AND map_debit IS NULL
                   THEN COALESCE(CASE WHEN n_debit IS NULL AND n_credit IS NULL THEN n_amount END,
                                 CASE WHEN n_debit IS NULL THEN p_amount END)
                   ELSE map_amount END AS amount_column,
              CASE WHEN map_amount IS NULL AND map_debit IS NULL THEN COALESCE(n_debit, map_debit) ELSE map_debit END AS debit_column,
              CASE WHEN map_amount IS NULL AND map_debit IS NULL THEN COALESCE(n_credit, map_credit) ELSE map_credit END AS credit_column,
              map_merchant AS merchant_column, map_description AS description_column FROM j),
u1 AS (SELECT file, unnest(list_filter([date_column, amount_column, debit_column, credit_column, merchant_column,
                                        description_column], lambda x: x IS NOT NULL)) AS c FROM s1),
s2 AS (SELECT s1.* REPLACE (COALESCE(merchant_column,
         (SELECT arg_min(bn."column", bn.rank) FROM bn WHERE bn.file = s1.file AND bn.field = 'merchant'
            AND bn."column" NOT IN (SELECT c FROM u1 WHERE u1.file = s1.file)),
         (SELECT arg_min(col, position) FROM prof WHERE prof.file = s1.file
            AND col NOT IN (SELECT c FROM u1 WHERE u1.file = s1.file)
            AND n20 >= 5 AND distinct20 / n20 > 0.5 AND avglen20 > 5)) AS merchant_column) FROM s1),
u2 AS (SELECT file, unnest(list_filter([date_column, amount_column, debit_column, credit_column, merchant_column,
                                        description_column], lambda x: x IS NOT NULL)) AS c FROM s2)
SELECT file, date_column, amount_column, merchant_column,
       COALESCE(description_column,
         (SELECT arg_min(bn."column", bn.rank) FROM bn WHERE bn.file = s2.file AND bn.field = 'description'
            AND bn."column" NOT IN (SELECT c FROM u2 WHERE u2.file = s2.file))) AS description_column,
       debit_column, credit_column,
       (SELECT arg_min(bn."column", bn.rank) FROM bn WHERE bn.file = s2.file AND bn.field = 'balance') AS balance_column
FROM s2"""


@register("detect_columns", _detect_columns_sql())
def q_detect_columns(spark, sf):
    rows, headers, prof = _export_profile(spark, sf)
    fmts = formats_df(spark)
    names = headers.select("file").distinct().select("file", export_name().alias("file_name"))
    ff = P.detect_format(headers, fmts, names)
    m = P.detect_columns(headers, prof, fmts, aliases_df(spark), ff)
    return m.withColumn("file", export_name())


@register("profile_date_col", f"""
WITH {_profiles_sql()}
SELECT file, arg_min(col, position) AS date_column FROM prof WHERE n10 > 0 AND dates10 >= n10 * 0.7 GROUP BY file""")
def q_profile_date_col(spark, sf):
    _, _, prof = _export_profile(spark, sf)
    return P.profile_date_col(prof).withColumn("file", export_name())


@register("profile_amount_col", f"""
WITH {_profiles_sql()}
SELECT file, arg_min(col, position) AS amount_column FROM prof
WHERE n20 > 0 AND nums20 >= n20 * 0.8 AND NOT contains(lower(col), 'balance') AND NOT contains(lower(col), 'running')
GROUP BY file""")
def q_profile_amount_col(spark, sf):
    _, _, prof = _export_profile(spark, sf)
    return P.profile_amount_col(prof).withColumn("file", export_name())


@register("profile_merchant_col", f"""
WITH {_profiles_sql()}
SELECT file, arg_min(col, position) AS merchant_column FROM prof
WHERE col NOT IN ('Date', 'Amount') AND n20 >= 5 AND distinct20 / n20 > 0.5 AND avglen20 > 5 GROUP BY file""")
def q_profile_merchant_col(spark, sf):
    _, headers, prof = _export_profile(spark, sf)
    used = headers.filter(F.col("column").isin("Date", "Amount")).select("file", "column")
    return P.profile_merchant_col(prof, used).withColumn("file", export_name())


@register("detect_description_balance",
          f"SELECT file, description_column, balance_column FROM ({_detect_columns_sql()})")
def q_detect_description_balance(spark, sf):
    m = q_detect_columns(spark, sf)
    return m.select("file", "description_column", "balance_column")


def _confidence_sql():
    from fintally.plans import q_import as QI
    return f"""
WITH {QI._formats_values_sql()}, {QI._FMT_SCORE_SQL},
det AS (SELECT f.file, COALESCE(b.format_id, 'generic') AS format_id
        FROM (SELECT DISTINCT file FROM v_file_headers) f LEFT JOIN (
          SELECT file, arg_min(sc.format_id, (-score, x.position)) AS format_id
          FROM sc JOIN fmts x ON sc.format_id = x.format_id WHERE score > 0 GROUP BY file) b ON f.file = b.file),
{QI._aliases_sql()},
lc AS (SELECT file, lower("column") AS alias, arg_max("column", position) AS "column" FROM v_file_headers GROUP BY 1, 2),
c AS (SELECT lc.file, al.field, lc."column", al.rank FROM lc JOIN al ON lc.alias = al.alias
      WHERE al.field IN ('date', 'amount', 'merchant', 'description')),
f1 AS (SELECT file, field, arg_min("column", rank) AS "column" FROM c WHERE field <> 'description' GROUP BY 1, 2),
mm AS (SELECT file, "column" AS m FROM f1 WHERE field = 'merchant'),
d1 AS (SELECT c.file, c.field FROM c LEFT JOIN mm ON c.file = mm.file
       WHERE c.field = 'description' AND (mm.m IS NULL OR c."column" <> mm.m) GROUP BY 1, 2),
n AS (SELECT file, COUNT(*) AS n FROM (SELECT file, field FROM f1 UNION ALL SELECT file, field FROM d1) GROUP BY file)
SELECT det.file, CASE WHEN det.format_id = 'generic' THEN 'low' WHEN COALESCE(n.n, 0) >= 4 THEN 'high'
                      WHEN COALESCE(n.n, 0) >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM det LEFT JOIN n ON det.file = n.file"""


@register("detect_confidence", _confidence_sql())
def q_detect_confidence(spark, sf):
    h = V.file_headers_view(spark, sf)
    names = h.select("file", F.col("file").alias("file_name")).distinct()
    ff = P.detect_format(h, formats_df(spark), names)
    by_name = P.detect_columns_by_name(h, aliases_df(spark))
    wide = by_name.groupBy("file").pivot("field", ["date", "amount", "merchant", "description"]).agg(F.first("column"))
    files = h.select("file").distinct()
    mapping = files.join(wide, "file", "left").select(
        "file", *[F.col(c).alias(f"{c}_column") for c in ["date", "amount", "merchant", "description"]],
        *[F.lit(None).cast("string").alias(c) for c in ["debit_column", "credit_column", "balance_column"]])
    return P.detect_confidence(ff, mapping)


_LEDGER_MONTHS = "SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS n FROM v_ledger GROUP BY 1"


@register("sink_append_ledger", """
SELECT strftime(date, '%Y-%m') AS month, id, date, CAST(amount AS DOUBLE) AS amount, merchant, description, category_id, account_id FROM v_ledger""")
def q_sink_append_ledger(spark, sf):
    """Two batches, the second one run twice."""
    path, led = scratch_dir(spark, "ledger"), V.ledger(spark, sf)
    for batch in (0, 1, 1):
        IO.sink_append_ledger(led.filter(F.col("id") % 2 == batch), path, f"b{batch}")
    return spark.read.parquet(path).select("month", "id", "date", M.out("amount").alias("amount"), "merchant", "description", "category_id", "account_id")


@register("src_ledger_scan", """
SELECT id, date, CAST(amount AS DOUBLE) AS amount, merchant FROM v_ledger
WHERE date >= DATE '2000-02-15' AND date <= DATE '2000-05-10'""")
def q_src_ledger_scan(spark, sf):
    path = scratch_dir(spark, "ledger")
    IO.sink_append_ledger(V.ledger(spark, sf), path)
    df = IO.src_ledger_scan(spark, path, dt.date(2000, 2, 15), dt.date(2000, 5, 10))
    return df.select("id", "date", M.out("amount").alias("amount"), "merchant")


@register("sink_append_vectors", """
SELECT transaction_id, merchant, category, amount, array_to_string(list_transform(vector, lambda x: floor(CAST(x AS DOUBLE) * 1000)::BIGINT), ',') AS vector FROM v_vectors""")
def q_sink_append_vectors(spark, sf):
    path = scratch_dir(spark, "vectors")
    for _ in range(2):
        IO.sink_append_vectors(V.vectors(spark, sf), path, "b0")
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 1000).cast("string"))
    return spark.read.parquet(path).select("transaction_id", "merchant", "category", "amount", F.array_join(whole, ",").alias("vector"))


@register("src_vectors", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE len(embedding) = 64) AS dim_ok FROM embeddings")
def q_src_vectors(spark, sf):
    path = scratch_dir(spark, "vectors")
    IO.sink_append_vectors(V.vectors(spark, sf), path)
    v = IO.src_vectors(spark, path, 64)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if("dim_ok").alias("dim_ok"))


@register("sink_append_log", f"""
{q_similarity._AUTO_J.rstrip()},
ids AS (SELECT qid, string_agg(CAST(bid AS VARCHAR), ',' ORDER BY rank) AS similar_ids FROM nn GROUP BY qid)
SELECT j.qid AS transaction_id, j.cid AS category_id, j.top_votes / j.n_similar AS confidence, ids.similar_ids,
       'Auto-categorized based on ' || j.top_votes || ' similar transactions all categorized as ' || j.top_category || '.' AS explanation
FROM j JOIN ids ON j.qid = ids.qid WHERE j.auto""")
def q_sink_append_log(spark, sf):
    from fintally.operators import similarity as SI
    led = V.ledger(spark, sf)
    nn = q_similarity._loo_stored(spark, sf)
    res = SI.auto_categorize(nn, V.vectors(spark, sf), V.categories(spark))
    _, _, log = SI.auto_categorize_apply(res, nn, led, V.categories(spark))
    path = scratch_dir(spark, "log")
    for _ in range(2):
        IO.sink_append_log(log, path, "b0")
    similar = F.array_join(F.col("similar_transaction_ids").cast("array<string>"), ",").alias("similar_ids")
    return spark.read.parquet(path).select("transaction_id", "category_id", "confidence", similar, "explanation")


# --- remaining functions ------------------------------------------------------------


@register("available_credit", """
SELECT id, CAST(GREATEST(0, a.initial_balance - (a.initial_balance - COALESCE(s.t, 0))) AS DOUBLE) AS available_credit
FROM v_accounts a LEFT JOIN (SELECT t.account_id, SUM(t.amount) AS t FROM v_ledger t JOIN v_accounts a2 ON t.account_id = a2.id
  WHERE a2.balance_as_of_date IS NULL OR t.date > a2.balance_as_of_date GROUP BY 1) s ON s.account_id = a.id
WHERE a.is_active AND a.account_type = 'credit'""")
def q_available_credit(spark, sf):
    st = AC.account_status(V.accounts(spark, sf), V.ledger(spark, sf), dt.date(2001, 7, 15))
    return st.filter(F.col("account_type") == "credit").select("id", "available_credit")


_FREQS = ["weekly", "biweekly", "semimonthly", "monthly", "yearly"]


@register("income_monthly_equivalent", f"""
SELECT account_id, frequency, CASE frequency WHEN 'weekly' THEN inc * 4.33 WHEN 'biweekly' THEN inc * 2.17
         WHEN 'semimonthly' THEN inc * 2 WHEN 'yearly' THEN inc / 12 ELSE inc END AS monthly_income
FROM (SELECT account_id, CAST(SUM(amount) AS DOUBLE) AS inc,
             [{", ".join(repr(f) for f in _FREQS)}][account_id % 5 + 1] AS frequency
      FROM v_ledger WHERE amount > 0 AND account_id IS NOT NULL GROUP BY account_id)""")
def q_income_monthly_equivalent(spark, sf):
    led = V.ledger(spark, sf)
    inc = (led.filter((F.col("amount") > 0) & F.col("account_id").isNotNull())
           .groupBy("account_id").agg(F.sum("amount").cast("double").alias("inc"))
           .withColumn("frequency", F.element_at(F.array(*[F.lit(f) for f in _FREQS]), (F.col("account_id") % 5 + 1).cast("int"))))
    return inc.select("account_id", "frequency", income_monthly_equivalent("inc", "frequency").alias("monthly_income"))


def _py_amount_text(amount_sql: str) -> str:
    return f"CASE WHEN ends_with(CAST({amount_sql} AS VARCHAR), '0') THEN left(CAST({amount_sql} AS VARCHAR), -1) ELSE CAST({amount_sql} AS VARCHAR) END"


@register("dedupe_key", f"""
SELECT id, sha256(strftime(date, '%Y-%m-%d') || '|' || {_py_amount_text('amount')} || '|' || merchant) AS dedupe_key
FROM v_ledger""")
def q_dedupe_key(spark, sf):
    return V.ledger(spark, sf).select("id", CH.dedupe_key().alias("dedupe_key"))


def _cards_sql():
    from fintally.plans import q_analytics as QA
    from fintally.plans import q_ledger as QL
    status, summary = QA.CATEGORY_STATUS_SQL, QA.SUMMARY_TOTALS_SQL
    overview = QL._OVERVIEW_SQL.replace("WITH fb AS", "WITH fb2 AS", 1).replace("FROM fb)", "FROM fb2)")
    return f"""
WITH st AS ({status}), sm AS ({summary}), ov AS ({overview})
SELECT 'Monthly Summary' AS card, CASE WHEN net >= 0 THEN 'net savings' ELSE 'net deficit' END AS subject,
       ABS(net) AS value, CAST(NULL AS BIGINT) AS count FROM sm
UNION ALL SELECT 'Action Required', 'uncategorized', NULL, uncategorized FROM sm WHERE uncategorized > 0
UNION ALL SELECT 'Budget Alert', arg_max(name, (budget_percent, -id)), arg_max(budget_percent, (budget_percent, -id)), NULL
  FROM st WHERE budget_amount > 0 AND budget_percent >= 100 HAVING COUNT(*) > 0
UNION ALL SELECT 'Budget Warning', arg_max(name, (budget_percent, -id)), arg_max(budget_percent, (budget_percent, -id)), NULL
  FROM st WHERE budget_amount > 0 AND budget_percent >= 80 AND budget_percent < 100 HAVING COUNT(*) > 0
UNION ALL SELECT 'Top Spending', arg_max(name, (spent, -id)), arg_max(spent, (spent, -id)), NULL
  FROM st WHERE spent > 0 HAVING COUNT(*) > 0
UNION ALL SELECT 'On Track', 'healthy budgets', NULL, COUNT(*) FROM st
  WHERE budget_amount > 0 AND budget_percent < 50 HAVING COUNT(*) > 0
UNION ALL SELECT 'Activity', 'total transactions', NULL, total_transactions FROM sm
UNION ALL SELECT CASE WHEN is_over THEN 'Spending Alert' WHEN percent_used >= 80 THEN 'Budget Warning'
                      ELSE 'Budget Status' END, 'discretionary',
                 CASE WHEN is_over THEN total_spent ELSE percent_used END, NULL
  FROM ov WHERE income_is_set AND (is_over OR percent_used >= 80 OR (discretionary_budget > 0 AND percent_used < 50))"""


@register("insight_cards", _cards_sql())
def q_insight_cards(spark, sf):
    led = V.ledger(spark, sf)
    cats = V.categories(spark)
    summary = A.summary_totals(led)
    status = A.category_status(led, cats, 2001, 7)
    ov = BU.budget_overview(led, V.bills(spark, sf), cats, V.settings(spark), V.BUDGET_MONTH)
    return BU.insight_cards(summary, status, ov)


# --- streaming variants, run to completion over files derived from the tables ---------


def _ledger_files(spark, sf):
    path = scratch_dir(spark, "ledger-stream-src")
    led = V.ledger(spark, sf).select("id", "date", "amount", "merchant", "description", "account_id", "category_id")
    led.repartition("id").write.parquet(path)
    return path, led.schema


def _run_available_now(df, mode, spark, name, foreach=None):
    out = scratch_dir(spark, f"{name}-out")
    ck = scratch_dir(spark, f"{name}-ckpt")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if foreach is not None:
        q = w.foreachBatch(lambda b, i: foreach(b, i, out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


def _upsert_batches(batch, batch_id, out):
    """The rows of one micro-batch as its own part; a batch that is run again replaces it."""
    (batch.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("batch_id").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(out))


@register("stream_daily_spending", """
SELECT date, CAST(SUM(ABS(amount)) AS DOUBLE) AS total, COUNT(*) AS n FROM v_ledger WHERE amount < 0 GROUP BY date""")
def q_stream_daily_spending(spark, sf):
    src, schema = _ledger_files(spark, sf)
    s = ST.stream_daily_spending(ST.read_transactions_stream(spark, src, schema, max_files_per_trigger=2))
    ups = spark.read.parquet(_run_available_now(s, "update", spark, "daily", foreach=_upsert_batches))
    return ups.groupBy("date").agg(F.max_by(F.struct("total", "n"), "batch_id").alias("s")).select("date", "s.*")


@register("stream_rules", f"""
WITH {q_changes._RULES_RANKED}
SELECT t.id, rr.category_id AS rule_category_id FROM v_ledger t LEFT JOIN best ON t.id = best.id LEFT JOIN rr ON rr.rk = best.rk""")
def q_stream_rules(spark, sf):
    src, schema = _ledger_files(spark, sf)
    s = ST.stream_rules(ST.read_transactions_stream(spark, src, schema), V.rules(spark), V.categories(spark))
    out = _run_available_now(s.select("id", "rule_category_id"), "append", spark, "rules")
    return spark.read.parquet(out)


@register("stream_running_balance", """
SELECT a.id AS account_id, CAST(CASE WHEN a.account_type = 'credit' THEN a.initial_balance - s.t
                                     ELSE a.initial_balance + s.t END AS DOUBLE) AS balance
FROM v_accounts a JOIN (SELECT t.account_id, SUM(t.amount) AS t FROM v_ledger t JOIN v_accounts a2 ON t.account_id = a2.id
  WHERE a2.balance_as_of_date IS NULL OR t.date > a2.balance_as_of_date GROUP BY 1) s ON s.account_id = a.id""")
def q_stream_running_balance(spark, sf):
    src, schema = _ledger_files(spark, sf)
    s = ST.stream_running_balance(ST.read_transactions_stream(spark, src, schema, max_files_per_trigger=2),
                                  V.accounts(spark, sf))
    out = _run_available_now(s, "update", spark, "balance", foreach=_upsert_batches)
    ups = spark.read.parquet(out)
    return ups.groupBy("account_id").agg(F.max_by("balance", "batch_id").alias("balance"))


@register("stream_goal_state", f"""
SELECT id AS goal_id, current_amount AS _c, completed_at, completing_contribution_id FROM ({q_ledger._GOAL_STATE_SQL})
WHERE completing_contribution_id IS NOT NULL""".replace("current_amount AS _c, ", ""))
def q_stream_goal_state(spark, sf):
    path, states = (scratch_dir(spark, n) for n in ("contrib-src", "goal-states"))
    contrib = V.contributions(spark, sf)
    contrib.repartition("id").write.parquet(path)
    source = spark.readStream.schema(contrib.schema).option("maxFilesPerTrigger", 2).parquet(path)
    s, writer = ST.stream_goal_state(source, V.goals(spark, sf), states)
    _run_available_now(s, "update", spark, "goals", foreach=lambda b, i, out: writer(b, i))
    done = ST.goal_states(spark, states).filter(F.col("completing_contribution_id").isNotNull())
    return done.select("goal_id", "completed_at", "completing_contribution_id")


@register("stream_ingest_dedupe", """
SELECT date, CAST(amount AS DOUBLE) AS amount, merchant, MIN(id) AS id FROM v_ledger GROUP BY ALL""")
def q_stream_ingest_dedupe(spark, sf):
    src, schema = _ledger_files(spark, sf)
    hist = scratch_dir(spark, "history")
    s, writer = ST.stream_ingest_dedupe(ST.read_transactions_stream(spark, src, schema), hist)
    _run_available_now(s, "append", spark, "dedupe", foreach=lambda b, i, out: writer(b, i))
    return spark.read.parquet(hist).select("date", M.out("amount").alias("amount"), "merchant", "id")
