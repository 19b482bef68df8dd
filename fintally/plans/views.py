"""Ledger views derived from the driver's TPC-H-style tables.

The driver tables hold no ledger, so the test and benchmark ledger is derived from them.
``oracle_views.py`` spells the same definitions in DuckDB SQL; both must stay in step.
Every view is a lazy DataFrame whose size grows with the source tables.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.schema import DEFAULT_CATEGORIES, MONEY

# As-of date of the derived ledger: the last order date in every scale factor.
AS_OF = dt.date(2001, 8, 1)
AS_OF_TS = dt.datetime(2001, 8, 1, 12, 0, 0)
BUDGET_MONTH = "2001-07"

# Fixed test dimensions (small literal tables, identical in the DuckDB twin).
CATEGORY_BUDGETS = [3000000, 800000, 2500000, 0, 1500000, 2000000, 2200000,
                    0, 500000, 1800000, 0, 0, 0, 1000000]
CATEGORY_KEYWORDS = ["rent,mortgage", "fuel,uber", "restaurant,grocery", "electric,water",
                     "pharmacy,doctor", "cinema,games", "store,amazon", "salon,spa",
                     "tuition,books", "hotel,airline", "netflix,spotify", "payroll,salary",
                     "transfer,zelle", ""]
TEST_RULES = [
    # id, name, rule_type, pattern, category_id, priority, is_active, minute offset
    (1, "big customers", "merchant_contains", "#0000001", 3, 10, True, 1),
    (2, "customer seven", "merchant_exact", "Customer#000000007", 11, 20, True, 2),
    (3, "urgent", "description_contains", "URGENT", 5, 5, True, 3),
    (4, "mid amounts", "amount_range", "100000,200000", 7, 5, True, 4),
    (5, "broken range", "amount_range", "abc,def", 1, 100, True, 5),
    (6, "retired one-off", "merchant_contains", "oneoff", 14, 50, False, 6),
    (7, "one-off", "merchant_contains", "ONEOFF", 14, 1, True, 7),
    (8, "small", "amount_range", " 0, 5000", 8, 0, True, 8),
    (9, "low priority text", "description_contains", "low", 6, 0, True, 9),
    (10, "nines", "merchant_contains", "9", 2, -1, True, 10),
    (11, "customer 42", "merchant_exact", "customer#000000042", 9, 30, True, 11),
    (12, "orphan", "merchant_contains", "customer", 99, 1000, True, 12),
    (13, "three-part range", "amount_range", "1,2,3", 4, 90, True, 13),
]
TEST_SETTINGS = [("monthly_income", "30000000.00"), ("savings_target_percent", "20"),
                 ("emergency_fund_months", "6"), ("discretionary_warning_percent", "80")]
BILL_FREQUENCIES = ["daily", "weekly", "biweekly", "monthly", "quarterly", "yearly",
                    "annually", "fortnightly"]
RECURRING_STEPS = [7, 14, 30, 90, 365, 10]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sign(cond):
    return F.when(cond, F.lit(1)).otherwise(F.lit(-1))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_ledger: one transaction per order, merchant = customer name."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    amount = (F.col("o_totalprice").cast(MONEY) * _sign(F.col("o_orderstatus") == "P")
              * F.when(k % 97 == 0, F.lit(10)).otherwise(F.lit(1))).cast(MONEY)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(
                k.alias("id"),
                F.col("o_orderdate").cast("date").alias("date"),
                amount.alias("amount"),
                F.when(k % 101 == 0, F.concat(F.lit("ONEOFF-"), k.cast("string")))
                 .otherwise(F.col("c_name")).alias("merchant"),
                F.col("o_orderpriority").alias("description"),
                F.when(k % 10 == 0, F.lit(None).cast("long"))
                 .otherwise(F.col("o_custkey") % 14 + 1).alias("category_id"),
                F.col("c_nationkey").cast("long").alias("account_id"),
                F.lit(False).alias("is_recurring"),
                F.lit(None).cast("long").alias("recurring_group_id"),
                (k % 97 == 0).alias("is_anomaly"),
                (k % 50 == 1).alias("is_split"),
                F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
            ))


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, CATEGORY_KEYWORDS[i], CATEGORY_BUDGETS[i])
            for i, n in enumerate(DEFAULT_CATEGORIES)]
    df = spark.createDataFrame(rows, "id long, name string, kw string, budget long")
    return df.select(
        "id", "name",
        F.when(F.col("kw") == "", F.array().cast("array<string>"))
         .otherwise(F.split("kw", ",")).alias("keywords"),
        F.col("budget").cast(MONEY).alias("budget_amount"),
        F.lit(None).cast("string").alias("color"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    return n.select(
        key.alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Bank "), F.col("n_regionkey").cast("string")).alias("institution"),
        F.element_at(F.array(*[F.lit(t) for t in ["checking", "savings", "credit", "investment"]]),
                     (key % 4 + 1).cast("int")).alias("account_type"),
        F.lpad((key * 37 % 10000).cast("string"), 4, "0").alias("last_four"),
        (key * 1000).cast(MONEY).alias("initial_balance"),
        F.when(key % 3 == 0, F.lit(None).cast("date"))
         .otherwise(F.lit(dt.date(1998, 1, 1))).alias("balance_as_of_date"),
        (key % 10 != 9).alias("is_active"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.concat(F.lit("Bill "), F.col("c_name")).alias("name"),
        F.col("c_name").alias("merchant"),
        (-F.abs(F.col("c_acctbal").cast(MONEY))).cast(MONEY).alias("amount"),
        F.element_at(F.array(*[F.lit(f) for f in BILL_FREQUENCIES]),
                     (key % 8 + 1).cast("int")).alias("frequency"),
        F.when(key % 9 == 0, F.lit(None).cast("long")).otherwise(key % 14 + 1).alias("category_id"),
        F.col("c_nationkey").cast("long").alias("account_id"),
        F.date_add(F.lit(dt.date(2001, 1, 1)), (key % 365).cast("int")).alias("start_date"),
        F.date_add(F.lit(AS_OF), (key % 41 - 10).cast("int")).alias("next_due_date"),
        F.lit(None).cast("date").alias("last_paid_date"),
        (key % 7 != 0).alias("is_active"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    paid = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("recurring_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount_paid"),
        F.date_sub(paid, (F.col("o_orderkey") % 5).cast("int")).alias("due_date"),
        paid.alias("paid_date"),
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per split parent: 60 % / rest; every 7th parent is off by 0.02."""
    led = ledger(spark, sf_dir).filter("is_split")
    cents = (F.abs(F.col("amount")) * 100).cast("long")
    first = F.expr("(cents * 6) div 10")
    base = led.select("id", "category_id", cents.alias("cents"))
    off = F.when(F.expr("(id div 50) % 7 = 0"), F.lit(2)).otherwise(F.lit(0))
    line1 = base.select(
        (F.col("id") * 10 + 1).alias("id"), F.col("id").alias("transaction_id"),
        F.expr("id % 14 + 1").alias("category_id"),
        (first.cast(MONEY) / 100).cast(MONEY).alias("amount"),
        F.lit("part 1").alias("description"))
    line2 = base.select(
        (F.col("id") * 10 + 2).alias("id"), F.col("id").alias("transaction_id"),
        F.expr("(id + 5) % 14 + 1").alias("category_id"),
        ((F.col("cents") - first + off).cast(MONEY) / 100).cast(MONEY).alias("amount"),
        F.lit("part 2").alias("description"))
    return line1.unionByName(line2)


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.when(key % 13 == 0, F.lit(0).cast(MONEY))
         .otherwise((F.abs(F.col("s_acctbal").cast(MONEY)) * 100).cast(MONEY)).alias("target_amount"),
        F.when(key % 4 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(dt.date(2001, 6, 1)), (key * 7 % 200).cast("int"))).alias("target_date"),
        (key % 11 != 10).alias("is_active"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n_goals = table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    return (o.select(
                F.col("o_orderkey").alias("id"),
                (F.col("o_custkey") % n_goals).alias("goal_id"),
                # o_totalprice / 100, truncated to whole cents
                (F.expr("(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) div 100)").cast(MONEY) / 100
                 * _sign(F.col("o_orderstatus") != "F")).cast(MONEY).alias("amount"),
                F.col("o_orderkey").alias("transaction_id"),
                F.col("o_orderdate").cast("timestamp_ntz").alias("created_at")))


def recurring_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_recurring: five dated charges per customer on a fixed step."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    step = F.element_at(F.array(*[F.lit(s) for s in RECURRING_STEPS]), (key % 6 + 1).cast("int"))
    off = key % 28 + F.col("i") * step + (key * F.col("i")) % 3
    return (c.select("c_custkey", "c_name", "c_acctbal", "c_nationkey",
                     F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
            .select(
                (key * 10 + F.col("i")).alias("id"),
                F.date_add(F.lit(dt.date(2024, 1, 1)), off.cast("int")).alias("date"),
                (-F.abs(F.col("c_acctbal").cast(MONEY))).cast(MONEY).alias("amount"),
                F.col("c_name").alias("merchant"),
                F.lit(None).cast("string").alias("description"),
                (key % 14 + 1).alias("category_id"),
                F.col("c_nationkey").cast("long").alias("account_id")))


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, n, t, p, c, pr, a, m) for (i, n, t, p, c, pr, a, m) in TEST_RULES]
    df = spark.createDataFrame(
        rows, "id long, name string, rule_type string, pattern string, category_id long, "
              "priority long, is_active boolean, m int")
    return df.select("id", "name", "rule_type", "pattern", "category_id", "priority", "is_active",
                     (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(mins=F.col("m")))
                     .alias("created_at"))


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEST_SETTINGS, "key string, value string")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_part_rules: a rule per part, with every rule kind; some inactive, some of no known category."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("merchant_contains", "merchant_exact", "description_contains", "amount_range")]), (k % 4 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("Rule "), k.cast("string")).alias("name"), kind.alias("rule_type"),
        F.when(k % 4 == 3, F.concat(size, F.lit(","), size, F.lit("00"))).otherwise(F.col("p_name")).alias("pattern"),
        (k % 17 + 1).alias("category_id"), F.col("p_size").cast("long").alias("priority"), (k % 7 != 0).alias("is_active"),
        F.lit(dt.datetime(2024, 1, 1)).alias("created_at"))


def supplier_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_supplier_categories: a user category per supplier; some budgets are negative."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("keywords"),
        F.col("s_acctbal").cast(MONEY).alias("budget_amount"), F.lit(None).cast("string").alias("color"))


def customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_customer_settings: a setting per customer: an amount, a whole number or a word."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("key"), F.when(k % 3 == 0, F.col("c_acctbal").cast(MONEY).cast("string"))
        .when(k % 3 == 1, k.cast("string")).otherwise(F.col("c_mktsegment")).alias("value"))


def template_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_template: a template line per part: every third names a supplier's category, the others are new."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("p_partkey"), "s_name")
    return p.join(s, "p_partkey", "left").select(
        F.coalesce("s_name", F.concat(F.col("p_name"), F.lit(" "), k.cast("string"))).alias("name"), F.col("p_type").alias("keywords"),
        F.col("p_retailprice").alias("budget_amount"), k.alias("position"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_vectors: the driver's embeddings as labelled transaction vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("transaction_id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("Merchant "), (F.col("vec_id") % 37).cast("string")).alias("merchant"),
        F.element_at(F.array(F.lit("Shopping"), F.lit("food & dining")),
                     (F.col("label") % 2 + 1).cast("int")).alias("category"),
        (F.col("vec_id") * 1.25).alias("amount"))


def categorization_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_log: categorisation log entries, several per order, from the line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("transaction_id"),
        (F.col("l_partkey") % 14 + 1).alias("category_id"),
        F.col("l_discount").alias("confidence"),
        F.col("l_returnflag").alias("explanation"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"))


def import_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_batch: a re-import export with one row per line item carrying its order's ledger key
    (file = export_<line number>, line = order key): in-batch copies come from multi-line
    orders, and orders before 1998 are already in the ledger (see ``existing_ledger``)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    led = ledger(spark, sf_dir).select("id", "date", "amount", "merchant", "description")
    return (li.join(led, li.l_orderkey == led.id)
            .select(F.concat(F.lit("export_"), F.col("l_linenumber").cast("string")).alias("file"),
                    F.col("l_orderkey").alias("line"), "date", "amount", "merchant", "description"))


def existing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter(F.col("date") < F.lit(dt.date(1998, 1, 1)))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_changes: keyed edits of ledger rows, one per line item (the 7th line deletes)."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    field = (F.when(n == 7, F.lit("__delete__"))
             .otherwise(F.element_at(F.array(*[F.lit(x) for x in ["category_id", "account_id", "description", "merchant"]]),
                                     (n % 4 + 1).cast("int"))))
    value = (F.when(n % 4 == 2, F.concat(F.col("l_returnflag"), F.col("l_linestatus")))
             .otherwise((F.col("l_partkey") % 20).cast("string")))
    return li.select(F.col("l_orderkey").alias("id"), field.alias("field"), value.alias("value"),
                     (F.col("l_suppkey") % 5).alias("seq"))


RAW_MERCHANTS = ["NETFLIX.COM", "Payroll ACME Corp", "Spotify USA", "Direct Deposit Employer", "Kroger #",
                 "Shell Oil ", "Amazon Mktp", "Rent Payment Landlord"]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_raw: one exported text row per order, with dates and amounts spelled in the formats
    banks use (and some junk), spread over 40 files by customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    v = (F.col("o_totalprice").cast(MONEY) * _sign(F.col("o_orderstatus") == "P")).cast(MONEY)
    vs = v.cast("string")
    fmt = [F.date_format(d, p) for p in ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "dd-MMM-yyyy", "dd/MM/yyyy"]]
    raw_date = (F.when(k % 6 == 0, fmt[0]).when(k % 6 == 1, fmt[1]).when(k % 6 == 2, fmt[2])
                .when(k % 6 == 3, fmt[3]).when(k % 6 == 4, fmt[4])
                .when(k % 60 == 5, F.lit("not a date")).otherwise(F.date_format(d, "yyyy/MM/dd")))
    # every 13th row: a spelling that only a general parser reads
    other = [F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit(" 10:30 AM")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z")),
             F.date_format(d, "MMM dd yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "MM-dd-yyyy"), F.date_format(d, "dd MMMM yyyy"),
             F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 23:59")), F.date_format(d, "yyyyMMdd"), F.date_format(d, "MMMM d, yyyy"),
             F.date_format(d, "EEE, dd MMM yyyy")]
    raw_date = F.when(k % 13 == 3, F.element_at(F.array(*other), (F.floor(k / 13) % len(other) + 1).cast("int"))).otherwise(raw_date)
    commas = F.format_number(v, 2)
    raw_amount = (F.when(k % 5 == 0, vs).when(k % 5 == 1, F.concat(F.lit("$"), commas))
                  .when(k % 5 == 2, F.when(v < 0, F.concat(F.lit("("), (-v).cast(MONEY).cast("string"), F.lit(")")))
                        .otherwise(vs))
                  .when(k % 5 == 3, F.concat(F.lit(" "), vs, F.lit(" ")))
                  .when(k % 50 == 4, F.lit("n/a")).otherwise(commas))
    ck = F.col("o_custkey")
    names = F.array(*[F.lit(m) for m in RAW_MERCHANTS])
    merchant = (F.when(k % 41 == 0, F.lit(None).cast("string"))
                .when(ck % 9 == 8, F.col("c_name"))
                .when(ck % 9 == 4, F.concat(F.lit("Kroger #"), ck.cast("string")))
                .when(ck % 9 == 5, F.concat(F.lit("Shell Oil "), ck.cast("string")))
                .otherwise(F.element_at(names, (ck % 9 + 1).cast("int"))))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.concat(F.lit("acct_"), F.floor(ck / 20).cast("string"), F.lit(".csv")).alias("file"),
                    k.alias("line"), raw_date.alias("raw_date"), raw_amount.alias("raw_amount"),
                    merchant.alias("raw_merchant"), F.col("o_orderpriority").alias("raw_description"),
                    F.when(v < 0, (-v).cast(MONEY).cast("string")).otherwise(F.lit("")).alias("raw_debit"),
                    F.when(v > 0, vs).otherwise(F.lit("")).alias("raw_credit")))


def file_headers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_file_headers: one export file per customer using the header of format c_custkey % 24;
    every third file name carries the institution."""
    from fintally.formats import BANK_FORMATS
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    idx = (k % len(BANK_FORMATS) + 1).cast("int")
    heads = F.array(*[F.array(*[F.lit(h) for h in f[4]]) for f in BANK_FORMATS])
    insts = F.array(*[F.lit(f[2].lower().replace(" ", "_")) for f in BANK_FORMATS])
    fname = F.concat(F.lit("export_"), k.cast("string"),
                     F.when(k % 3 == 0, F.concat(F.lit("_"), F.element_at(insts, idx))).otherwise(F.lit("")),
                     F.lit(".csv"))
    return c.select(fname.alias("file"), F.posexplode(F.element_at(heads, idx)).alias("position", "column"))
