"""Import profiling over many files at once: bank-format detection, column detection by
name and by value profiles, per-file totals, subscription/income hints, account type and
the onboarding spending analysis.

Inputs are long-form frames: ``headers`` (file, position, column) and ``cells``
(file, blk, pos, position, column, value). Substring tests against the fixed format table
are a ``filter`` over a literal array per distinct header, so no file x format pairs are
joined or shuffled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fintally.formats import (INCOME_PATTERNS, KEYWORD_CATEGORIES, SPLIT_CREDIT_NAMES,
                              SPLIT_CREDIT_PARTS, SPLIT_DEBIT_NAMES, SPLIT_DEBIT_PARTS, SUBSCRIPTION_PATTERNS)
from fintally.functions.normalize import (norm_amount, norm_date, norm_description, norm_merchant,
                                          norm_split_amount_analysis)


def _format_column_array():
    """Fixed (format_id, lower-case column, weight) entries of every non-generic format."""
    from fintally.formats import BANK_FORMATS
    entries = []
    for f, _n, _inst, _at, headers, sigs, _m in BANK_FORMATS:
        if f == "generic":
            continue
        entries += [(f, c.lower(), 3) for c in sigs] + [(f, c.lower(), 1) for c in headers]
    return F.array(*[F.struct(F.lit(f).alias("format_id"), F.lit(c).alias("col"), F.lit(w).alias("weight"))
                     for f, c, w in entries])


def _institution_array():
    from fintally.formats import BANK_FORMATS
    return F.array(*[F.struct(F.lit(f).alias("format_id"), F.lit(inst.lower()).alias("inst"))
                     for f, _n, inst, *_ in BANK_FORMATS if f != "generic" and inst])


def detect_format(headers: DataFrame, formats: DataFrame, file_names: DataFrame | None = None) -> DataFrame:
    """Best bank format per file: +3 per signature column and +1 per expected header that
    equals or is contained in a file header (case-insensitive), +5 when the institution
    name is contained in the file name. Highest score wins, earlier formats win ties; a
    file with no positive score is 'generic'. Returns (file, format_id, score).

    The format table is a fixed list of about 150 names, so each distinct header name is tested once,
    with one ``filter`` over a literal array, and only its hits are joined to the files.
    """
    hs = headers.select("file", F.lower(F.trim("column")).alias("h")).distinct()
    # names repeat over files: each is tested once
    hits = hs.select("h").distinct().select("h", F.explode(F.filter(_format_column_array(), lambda e: F.contains(F.col("h"), e["col"]))).alias("e"))
    matched = (hs.join(hits, "h").select("file", F.col("e.format_id").alias("format_id"), F.col("e.col").alias("col"),
                       F.col("e.weight").alias("weight"))
               .distinct())
    score = matched.groupBy("file", "format_id").agg(F.sum("weight").alias("score"))
    if file_names is not None:
        fn = file_names.select("file", F.lower(F.col("file_name")).alias("fname"))
        bonus = (fn.select("file", F.explode(F.filter(_institution_array(),
                                                      lambda e: F.contains(F.col("fname"), e["inst"]))).alias("e"))
                 .select("file", F.col("e.format_id").alias("format_id")).distinct()
                 .withColumn("score", F.lit(5).cast("long")))
        score = score.unionByName(bonus).groupBy("file", "format_id").agg(F.sum("score").alias("score"))
    pos = formats.select("format_id", "position")
    best = (score.filter(F.col("score") > 0).join(F.broadcast(pos), "format_id")
            .groupBy("file").agg(F.min_by(F.struct("format_id", "score"),
                                          F.struct(-F.col("score"), F.col("position"))).alias("b")))
    files = headers.select("file").distinct()
    if file_names is not None:
        files = files.unionByName(file_names.select("file")).distinct()
    return (files.join(best, "file", "left")
            .select("file", F.coalesce(F.col("b.format_id"), F.lit("generic")).alias("format_id"),
                    F.coalesce(F.col("b.score"), F.lit(0)).cast("long").alias("score")))


def detect_columns_by_name(headers: DataFrame, aliases: DataFrame,
                           fields=("date", "amount", "merchant", "description")) -> DataFrame:
    """Parser mapping by exact lower-case names: for each field the first alias (list order)
    present among the file's headers; the description must differ from the merchant column.
    When two headers lower-case to the same name the later one is used. (file, field, column)."""
    lc = (headers.select("file", "position", "column", F.lower(F.col("column")).alias("alias"))
          .groupBy("file", "alias").agg(F.max_by("column", "position").alias("column")))
    cand = lc.join(F.broadcast(aliases.filter(F.col("field").isin(*fields))), "alias")
    first = cand.filter(F.col("field") != "description").groupBy("file", "field") \
        .agg(F.min_by("column", "rank").alias("column"))
    merch = first.filter(F.col("field") == "merchant").select("file", F.col("column").alias("_m"))
    desc = (cand.filter(F.col("field") == "description").join(merch, "file", "left")
            .filter(F.col("_m").isNull() | (F.col("column") != F.col("_m")))
            .groupBy("file", "field").agg(F.min_by("column", "rank").alias("column")))
    return first.unionByName(desc)


def cells(rows: DataFrame) -> DataFrame:
    """Unpivot import rows to (file, blk, pos, position, column, value); '' counts as missing."""
    z = rows.select("file", "blk", "pos", F.posexplode(F.arrays_zip("header", "values")).alias("position", "hv"))
    return z.select("file", "blk", "pos", "position", F.col("hv.header").alias("column"),
                    F.when(F.length("hv.values") > 0, F.col("hv.values")).alias("value"))


def column_profiles(cell_df: DataFrame) -> DataFrame:
    """Per (file, column): share of date-like values among the first 10 non-missing values,
    share of numeric values among the first 20, and the text profile of the first 20
    (count, distinct ratio, mean length). Per-column top-20 is a window group limit."""
    nn = cell_df.filter(F.col("value").isNotNull())
    w = Window.partitionBy("file", "position").orderBy("blk", "pos")
    top = nn.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 20)
    first10 = F.col("k") <= 10
    return (top.groupBy("file", "position", "column")
            .agg(F.count_if(first10).alias("n10"),
                 F.count_if(first10 & norm_date(F.col("value")).isNotNull()).alias("dates10"),
                 F.count(F.lit(1)).alias("n20"),
                 F.count_if(norm_amount(F.col("value")).isNotNull()).alias("nums20"),
                 F.countDistinct("value").alias("distinct20"),
                 F.avg(F.length("value")).alias("avglen20")))


def profile_date_col(profiles: DataFrame) -> DataFrame:
    """First column (file order) whose first 10 values are at least 70 % dates."""
    ok = profiles.filter((F.col("n10") > 0) & (F.col("dates10") >= F.col("n10") * 0.7))
    return ok.groupBy("file").agg(F.min_by("column", "position").alias("date_column"))


def profile_amount_col(profiles: DataFrame) -> DataFrame:
    """First column whose first 20 values are at least 80 % numbers, skipping balance-like names."""
    lc = F.lower("column")
    ok = profiles.filter((F.col("n20") > 0) & (F.col("nums20") >= F.col("n20") * 0.8)
                         & ~F.contains(lc, F.lit("balance")) & ~F.contains(lc, F.lit("running")))
    return ok.groupBy("file").agg(F.min_by("column", "position").alias("amount_column"))


def profile_merchant_col(profiles: DataFrame, used: DataFrame) -> DataFrame:
    """First unused column with >= 5 values, distinct ratio > 0.5 and mean length > 5.
    ``used`` is (file, column) of columns already mapped."""
    ok = (profiles.join(used, ["file", "column"], "left_anti")
          .filter((F.col("n20") >= 5) & (F.col("distinct20") / F.col("n20") > 0.5) & (F.col("avglen20") > 5)))
    return ok.groupBy("file").agg(F.min_by("column", "position").alias("merchant_column"))


def detect_split_amounts(headers: DataFrame) -> DataFrame:
    """Per file: both a debit-like and a credit-like header present (exact names), and the
    first header containing debit/withdraw/outflow and credit/deposit/inflow."""
    lc = F.lower("column")
    has_d = lc.isin(*SPLIT_DEBIT_NAMES)
    has_c = lc.isin(*SPLIT_CREDIT_NAMES)
    part_d = F.exists(F.array(*[F.lit(p) for p in SPLIT_DEBIT_PARTS]), lambda p: F.contains(lc, p))
    part_c = F.exists(F.array(*[F.lit(p) for p in SPLIT_CREDIT_PARTS]), lambda p: F.contains(lc, p))
    return headers.groupBy("file").agg(
        (F.max(has_d.cast("int")) + F.max(has_c.cast("int")) == 2).alias("detected"),
        F.min_by(F.when(part_d, F.col("column")), F.when(part_d, F.col("position"))).alias("debit_column"),
        F.min_by(F.when(part_c, F.col("column")), F.when(part_c, F.col("position"))).alias("credit_column"))


def detect_columns(headers: DataFrame, profiles: DataFrame, formats: DataFrame, aliases: DataFrame,
                   file_formats: DataFrame) -> DataFrame:
    """Smart mapping per file (one row, seven columns): the detected format's mapping when its
    column exists (exact name), then name lists, then value profiles, in the reference's order.
    """
    cols = headers.select("file", "column").distinct()
    fm = (file_formats.select("file", "format_id")
          .join(F.broadcast(formats.select("format_id", "map_date", "map_merchant", "map_amount",
                                           "map_description", "map_debit", "map_credit")), "format_id", "left"))
    # keep a mapped column only when the file has it (exact name)
    for f in ["map_date", "map_merchant", "map_amount", "map_description", "map_debit", "map_credit"]:
        present = cols.select("file", F.col("column").alias(f), F.lit(True).alias(f"_{f}"))
        fm = fm.join(present, ["file", f], "left").withColumn(f, F.when(F.col(f"_{f}"), F.col(f))).drop(f"_{f}")
    by_name = (headers.select("file", "position", "column", F.lower("column").alias("alias"))
               .groupBy("file", "alias").agg(F.max_by("column", "position").alias("column"))
               .join(F.broadcast(aliases), "alias"))
    first_alias = by_name.groupBy("file", "field").agg(F.min_by("column", "rank").alias("column"))
    pivot = first_alias.groupBy("file").pivot("field", ["date", "amount", "debit", "credit", "merchant",
                                                        "description", "balance"]).agg(F.first("column"))
    pdate = profile_date_col(profiles)
    pamt = profile_amount_col(profiles)
    j = (fm.join(pivot.select("file", *[F.col(c).alias(f"n_{c}") for c in
                                         ["date", "amount", "debit", "credit", "balance"]]), "file", "left")
         .join(pdate, "file", "left").join(pamt, "file", "left"))
    date_c = F.coalesce("map_date", "n_date", "date_column")
    # amount/debit/credit by name and value only when the format gave neither amount nor debit
    need_amt = F.col("map_amount").isNull() & F.col("map_debit").isNull()
    named_single = F.when(F.col("n_debit").isNull() & F.col("n_credit").isNull(), F.col("n_amount"))
    single = F.coalesce(named_single, F.when(F.col("n_debit").isNull(), F.col("amount_column")))
    amount_c = F.when(need_amt, single).otherwise(F.col("map_amount"))
    debit_c = F.when(need_amt, F.coalesce("n_debit", "map_debit")).otherwise(F.col("map_debit"))
    credit_c = F.when(need_amt, F.coalesce("n_credit", "map_credit")).otherwise(F.col("map_credit"))
    step1 = j.select("file", date_c.alias("date_column"), amount_c.alias("amount_column"),
                     debit_c.alias("debit_column"), credit_c.alias("credit_column"),
                     F.col("map_merchant").alias("merchant_column"),
                     F.col("map_description").alias("description_column"))
    used = step1.select("file", F.explode(F.array_compact(F.array(
        "date_column", "amount_column", "debit_column", "credit_column", "merchant_column",
        "description_column"))).alias("column"))
    # merchant by name (first alias not used), else by profile
    m_alias = (by_name.filter(F.col("field") == "merchant").join(used, ["file", "column"], "left_anti")
               .groupBy("file").agg(F.min_by("column", "rank").alias("m_name")))
    m_prof = profile_merchant_col(profiles, used)
    step2 = (step1.join(m_alias, "file", "left")
             .join(m_prof.withColumnRenamed("merchant_column", "m_prof"), "file", "left")
             .withColumn("merchant_column", F.coalesce("merchant_column", "m_name", "m_prof"))
             .drop("m_name", "m_prof"))
    used2 = step2.select("file", F.explode(F.array_compact(F.array(
        "date_column", "amount_column", "debit_column", "credit_column", "merchant_column",
        "description_column"))).alias("column"))
    d_alias = (by_name.filter(F.col("field") == "description").join(used2, ["file", "column"], "left_anti")
               .groupBy("file").agg(F.min_by("column", "rank").alias("d_name")))
    bal = by_name.filter(F.col("field") == "balance").groupBy("file") \
        .agg(F.min_by("column", "rank").alias("balance_column"))
    return (step2.join(d_alias, "file", "left").join(bal, "file", "left")
            .withColumn("description_column", F.coalesce("description_column", "d_name")).drop("d_name")
            .select("file", "date_column", "amount_column", "merchant_column", "description_column",
                    "debit_column", "credit_column", "balance_column"))


def detect_confidence(file_formats: DataFrame, mapping: DataFrame) -> DataFrame:
    """generic -> low; >= 4 mapped fields -> high; >= 2 -> medium; else low."""
    n = F.size(F.array_compact(F.array("date_column", "amount_column", "merchant_column", "description_column",
                                       "debit_column", "credit_column", "balance_column")))
    return (file_formats.join(mapping, "file")
            .select("file", F.when(F.col("format_id") == "generic", F.lit("low"))
                    .when(n >= 4, F.lit("high")).when(n >= 2, F.lit("medium")).otherwise(F.lit("low"))
                    .alias("confidence")))


# --- row conversion ------------------------------------------------------------


def converted_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Batch-import conversion with a per-file mapping (file, date_column, amount_column,
    merchant_column, description_column). Every row has a ``status``: ok, missing_date, bad_date, missing_amount
    or bad_amount."""
    j = rows.join(mapping, "file")
    get = lambda c: F.when(F.col(c).isNotNull(), F.try_element_at(F.col("row"), F.col(c)))
    raw_d, raw_a = get("date_column"), get("amount_column")
    m, desc = get("merchant_column"), get("description_column")
    # parse once; the status and the outputs reuse the parsed columns (one codegen unit each)
    raw = j.select("file", "blk", "pos", F.when(F.length(raw_d) > 0, raw_d).alias("raw_date"),
                   F.when(F.length(raw_a) > 0, raw_a).alias("raw_amount"),
                   F.when(F.length(m) > 0, m).alias("raw_merchant"),
                   F.when(F.length(desc) > 0, desc).alias("raw_description"))
    parsed = raw.select("*", norm_date(F.col("raw_date")).alias("date"), norm_amount(F.col("raw_amount")).alias("amount"))
    status = (F.when(F.col("raw_date").isNull(), F.lit("missing_date"))
              .when(F.col("raw_amount").isNull(), F.lit("missing_amount"))
              .when(F.col("date").isNull(), F.lit("bad_date"))
              .when(F.col("amount").isNull(), F.lit("bad_amount")).otherwise(F.lit("ok")))
    return parsed.select("file", "blk", "pos", "date", "amount",
                         norm_merchant(F.col("raw_merchant")).alias("merchant"),
                         norm_description(F.col("raw_description")).alias("description"),
                         status.alias("status"))


def norm_row(rows: DataFrame, mapping: DataFrame):
    """``converted_rows`` as (good, rejected): good rows have a parsed date and amount; rejected rows keep their
    ``status``."""
    out = converted_rows(rows, mapping)
    return out.filter(F.col("status") == "ok").drop("status"), out.filter(F.col("status") != "ok")


def norm_onboarding_row(rows: DataFrame, mapping: DataFrame):
    """Onboarding import: amount parsed (empty or zero rows skipped), merchant = the chosen
    description column trimmed, description = its first 100 characters, date parsed from the
    first token (kept as raw text when no pattern fits). Returns (good, skipped)."""
    from fintally.formats import ONBOARDING_DATE_PATTERNS
    from fintally.functions.normalize import norm_date_first_token, onboarding_amount

    j = rows.join(mapping, "file")
    get = lambda c: F.try_element_at(F.col("row"), F.col(c))
    amt = onboarding_amount(get("amount_column"))
    merchant = F.trim(F.coalesce(get("description_column"), F.lit("")))
    d = norm_date_first_token(get("date_column"), ONBOARDING_DATE_PATTERNS)
    out = j.select("file", "blk", "pos", amt.alias("amount"), merchant.alias("merchant"),
                   F.substring(merchant, 1, 100).alias("description"),
                   F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.trim(F.coalesce(get("date_column"), F.lit(""))))
                   .alias("date_text"))
    ok = F.col("amount").isNotNull() & (F.col("amount") != 0)
    return out.filter(ok), out.filter(~ok)


# --- per-file analysis ---------------------------------------------------------


def file_amounts(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, blk, pos, amount, signed_amount, merchant_l, date) as the analysis reads them: the amount
    column, else credit - debit (credit non-zero) or -|debit|. ``signed_amount``, for the account
    type, is -debit in the last case, whatever the debit's sign, and never missing."""
    j = rows.join(mapping, "file")
    get = lambda c: F.when(F.col(c).isNotNull(), F.try_element_at(F.col("row"), F.col(c)))
    amt = F.when(F.col("amount_column").isNotNull(), norm_amount(get("amount_column"))) \
        .when(F.col("debit_column").isNotNull() | F.col("credit_column").isNotNull(),
              norm_split_amount_analysis(get("debit_column"), get("credit_column")))
    signed = F.when(F.col("amount_column").isNull() & (F.col("debit_column").isNotNull() | F.col("credit_column").isNotNull()),
                    norm_split_amount_analysis(get("debit_column"), get("credit_column"), account_type_variant=True)).otherwise(amt)
    return j.select("file", "blk", "pos", amt.alias("amount"), signed.alias("signed_amount"),
                    F.lower(F.trim(get("merchant_column"))).alias("merchant_l"),
                    norm_date(get("date_column")).alias("date"))


def profile_file_totals(amounts: DataFrame) -> DataFrame:
    """Per file: date range, income/expense totals and counts, mean |amount| (2 dp) and the
    largest expense and income."""
    a = F.col("amount")
    return amounts.groupBy("file").agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.count(a).alias("transaction_count"),
        F.count_if(a > 0).alias("income_count"), F.count_if(a < 0).alias("expense_count"),
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)).alias("total_income"),
        F.coalesce(F.sum(F.when(a < 0, -a)), F.lit(0.0)).alias("total_expenses"),
        F.coalesce(F.max(F.when(a < 0, -a)), F.lit(0.0)).alias("largest_expense"),
        F.coalesce(F.max(F.when(a > 0, a)), F.lit(0.0)).alias("largest_income"),
        (F.sum(F.abs(a)) / F.count(a)).alias("avg_transaction"))


def _top_merchants(amounts: DataFrame, top: int) -> DataFrame:
    counts = (amounts.filter(F.col("merchant_l").isNotNull() & (F.length("merchant_l") > 0))
              .groupBy("file", "merchant_l").agg(F.count(F.lit(1)).alias("count"),
                                                 F.min(F.struct("blk", "pos")).alias("first")))
    w = Window.partitionBy("file").orderBy(F.desc("count"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _any_regex(col, patterns):
    """re.search with any of ``patterns`` (case-insensitive): one alternation, one scan."""
    return col.rlike("(?i)(" + "|".join(patterns) + ")")


def title_case(c):
    """A letter behind anything but a letter is upper case, all others lower case."""
    runs = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})", -1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def potential_subscriptions(amounts: DataFrame, top: int = 20, min_count: int = 2) -> DataFrame:
    """Among each file's ``top`` most frequent merchants, those seen at least twice that match a
    subscription pattern (title-cased)."""
    t = _top_merchants(amounts, top)
    return (t.filter((F.col("count") >= min_count) & _any_regex(F.col("merchant_l"), SUBSCRIPTION_PATTERNS))
            .select("file", "rank", title_case(F.col("merchant_l")).alias("merchant")))


def potential_income_sources(amounts: DataFrame, top: int = 20) -> DataFrame:
    t = _top_merchants(amounts, top)
    return (t.filter(_any_regex(F.col("merchant_l"), INCOME_PATTERNS))
            .select("file", "rank", title_case(F.col("merchant_l")).alias("merchant")))


def detect_account_type(amounts: DataFrame, file_formats: DataFrame, formats: DataFrame,
                        mapping: DataFrame) -> DataFrame:
    """Account type per file from the sign mix of amounts, payment/payroll merchants, a
    balance column and the format's own type. Returns (file, type, confidence, hints)."""
    a = F.col("signed_amount")
    stats = amounts.groupBy("file").agg(
        F.count(a).alias("total"), F.count_if(a > 0).alias("pos"), F.count_if(a < 0).alias("neg"),
        F.count_if(F.col("merchant_l").rlike("payment|thank you")).alias("payments"),
        F.count_if(F.col("merchant_l").rlike("direct dep|payroll|salary")).alias("payroll"))
    fmt = file_formats.join(F.broadcast(formats.select("format_id", F.col("account_type").alias("fmt_type"),
                                                       F.col("name").alias("fmt_name"))), "format_id")
    j = fmt.join(mapping.select("file", "merchant_column", "balance_column", "amount_column", "debit_column"),
                 "file").join(stats, "file", "left")
    total, pos, neg = F.col("total"), F.col("pos"), F.col("neg")
    has_amounts = (F.col("amount_column").isNotNull() | F.col("debit_column").isNotNull()) & (total > 0)
    has_m = F.col("merchant_column").isNotNull()
    credit = neg > total * 0.7
    checking = ~credit & (pos > total * 0.1) & (neg > total * 0.3)
    savings = ~credit & ~checking & (pos > total * 0.5)
    t0 = (F.when(has_amounts & credit, F.lit("credit_card"))
          .when(has_amounts & checking, F.lit("checking"))
          .when(has_amounts & savings, F.lit("savings")).otherwise(F.col("fmt_type")))
    c0 = (F.when(has_amounts & credit, F.when(has_m & (F.col("payments") >= 1), F.lit("high")).otherwise(F.lit("medium")))
          .when(has_amounts & checking, F.when(has_m & (F.col("payroll") >= 1), F.lit("high")).otherwise(F.lit("medium")))
          .when(has_amounts & savings, F.lit("medium")).otherwise(F.lit("low")))
    # checking needs a merchant column to be set at all
    t0 = F.when(has_amounts & checking & ~has_m, F.col("fmt_type")).otherwise(t0)
    c0 = F.when(has_amounts & checking & ~has_m, F.lit("low")).otherwise(c0)
    bal = has_amounts & F.col("balance_column").isNotNull()
    t1 = F.when(bal & (t0 == "unknown"), F.lit("checking")).otherwise(t0)
    c1 = F.when(bal & (t0 == "unknown"), F.lit("medium")).otherwise(c0)
    override = has_amounts & F.col("fmt_type").isin("credit_card", "checking", "savings")
    t2 = F.when(override, F.col("fmt_type")).otherwise(t1)
    c2 = F.when(override & (c1 == "low"), F.lit("medium")).otherwise(c1)
    hints = F.array_compact(F.array(
        F.when(has_amounts & credit, F.lit("Mostly expenses (typical for credit card)")),
        F.when(has_amounts & credit & has_m & (F.col("payments") >= 1), F.lit("Found payment transactions")),
        F.when(has_amounts & checking & has_m & (F.col("payroll") >= 1), F.lit("Found direct deposit transactions")),
        F.when(has_amounts & checking & has_m & (F.col("payroll") < 1), F.lit("Mix of income and expenses")),
        F.when(has_amounts & savings, F.lit("Mostly deposits")),
        F.when(bal, F.lit("Has running balance")),
        F.when(override, F.concat(F.lit("Format signature: "), F.col("fmt_name")))))
    return j.select("file", t2.alias("type"), c2.alias("confidence"), F.array_join(hints, "; ").alias("hints"))


def keyword_category(merchant) -> F.Column:
    """First onboarding category having a keyword contained in lower(merchant), else 'Other'."""
    m = F.lower(F.col(merchant) if isinstance(merchant, str) else merchant)
    expr = None
    for cat, kws in KEYWORD_CATEGORIES:
        cond = F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.contains(m, k))
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit("Other"))


def csv_spend_analysis(txns: DataFrame):
    """Onboarding analysis per file of (file, amount, merchant, date) rows with non-zero
    amounts: months = max(1, days spanned / 30); income and spending totals, counts and monthly
    estimates; monthly spending per keyword category. Returns (summary, by_category)."""
    a = F.col("amount")
    rng = txns.groupBy("file").agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0.0)).alias("income_total"),
        F.count_if(a > 0).alias("income_count"),
        F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0.0))).alias("spending_total"),
        F.count_if(a < 0).alias("spending_count"))
    months = F.when(F.col("min_date").isNull(), F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.datediff("max_date", "min_date") / 30.0))
    summary = rng.withColumn("months", months).select(
        "file", "min_date", "max_date", "total_transactions", "months",
        "income_total", "income_count", (F.col("income_total") / F.col("months")).alias("income_monthly"),
        "spending_total", "spending_count", (F.col("spending_total") / F.col("months")).alias("spending_monthly"))
    cat = (txns.filter(a < 0).withColumn("category", keyword_category(F.col("merchant")))
           .groupBy("file", "category")
           # amounts are 2-decimal money: summing them as DECIMAL keeps the total order-independent
           .agg(F.sum(F.abs(a).cast("decimal(20,2)")).cast("double").alias("spent")))
    by_cat = cat.join(summary.select("file", "months"), "file").select(
        "file", "category", (F.col("spent") / F.col("months")).alias("monthly"))
    return summary, by_cat
