"""Budgets: fixed costs from bills, category budgets for a month, the overview row,
warnings, health label, insight cards, method templates and blending with actuals.

The overview is a handful of one-row aggregates combined with scalar subqueries; every
aggregate is a partial (map-side) aggregate over the ledger, and nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.dates import month_bounds
from fintally.functions.schedule import bill_monthly_equivalent
from fintally.operators.select import setting_value


def fixed_costs_bills(bills: DataFrame, categories: DataFrame) -> DataFrame:
    """Active bills with their category name and monthly equivalent (rounded to cents)."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return (bills.filter(F.col("is_active")).join(cats, "category_id", "left")
            .withColumn("_monthly", bill_monthly_equivalent("amount", "frequency"))
            .withColumn("monthly_equivalent", F.round("_monthly", 2).cast("double")))


def fixed_costs(bills: DataFrame, categories: DataFrame) -> DataFrame:
    """Monthly fixed costs per category ('Uncategorized' for none) plus a grand-total row.

    ``rollup`` yields the per-category rows and the total (category NULL, is_total) in one
    aggregation; sums are exact decimals rounded once at the end.
    """
    b = fixed_costs_bills(bills, categories).withColumn(
        "category", F.coalesce("category_name", F.lit("Uncategorized")))
    return (b.rollup("category")
            .agg(F.round(F.sum("_monthly"), 2).cast("double").alias("total"),
                 F.count(F.lit(1)).alias("bill_count"),
                 F.grouping("category").cast("boolean").alias("is_total")))


def fixed_total(bills: DataFrame, categories: DataFrame):
    """Scalar Column: total monthly fixed costs, rounded to cents (0 with no bills)."""
    b = fixed_costs_bills(bills, categories)
    return b.select(F.coalesce(F.round(F.sum("_monthly"), 2), F.lit(0)).cast("double")).scalar()


def budget_categories(txns: DataFrame, categories: DataFrame, month: str) -> DataFrame:
    """Budgeted categories in ``month`` ('YYYY-MM', half-open bounds): spent, remaining,
    percent used (1 dp) and the over-budget flag."""
    start, end = month_bounds(month)
    spent = (txns.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end))
                         & (F.col("amount") < 0))
             .groupBy("category_id").agg(F.sum(F.abs("amount")).alias("spent")))
    cats = categories.filter(F.col("budget_amount") > 0)
    s = F.coalesce("spent", M.zero())
    b = F.col("budget_amount")
    return (cats.join(spent, cats.id == spent.category_id, "left")
            .select("id", "name", M.out(b).alias("budget_amount"), M.out(s).alias("spent"),
                    M.out(b - s).alias("remaining"),
                    M.round_double(s.cast("double") / b.cast("double") * 100, 1).alias("percent_used"),
                    (s > b).alias("over_budget")))


def budget_overview(txns: DataFrame, bills: DataFrame, categories: DataFrame,
                    settings: DataFrame, month: str) -> DataFrame:
    """One row: income, fixed costs, savings target, discretionary budget/spent/remaining,
    percent used, category-budget totals and net remaining for ``month``."""
    start, end = month_bounds(month)
    income = setting_value(settings, "monthly_income", 0.0).scalar()
    pct = setting_value(settings, "savings_target_percent", 20.0).scalar()
    fixed = fixed_total(bills, categories)
    in_month = txns.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    total_spent = in_month.filter(F.col("amount") < 0).select(
        F.coalesce(F.sum(F.abs("amount")), M.zero()).cast("double")).scalar()
    bc = budget_categories(txns, categories, month).agg(
        F.coalesce(F.sum(F.col("budget_amount").cast("decimal(18,2)")), M.zero()).cast("double").alias("tb"),
        F.coalesce(F.sum(F.col("spent").cast("decimal(18,2)")), M.zero()).cast("double").alias("ts"))
    savings = income * (pct / F.lit(100.0))
    disc = income - fixed - savings
    remaining = disc - total_spent
    return bc.select(
        F.lit(month).alias("month"),
        income.alias("monthly_income"),
        (income > 0).alias("income_is_set"),
        fixed.alias("total_fixed"),
        pct.alias("savings_target_percent"),
        M.round_double(savings, 2).alias("savings_target"),
        M.round_double(disc, 2).alias("discretionary_budget"),
        M.round_double(total_spent, 2).alias("total_spent"),
        M.round_double(remaining, 2).alias("discretionary_remaining"),
        F.when(disc > 0, M.round_double(total_spent / disc * 100, 1)).otherwise(F.lit(0.0)).alias("percent_used"),
        (remaining < 0).alias("is_over"),
        M.round_double("tb", 2).alias("total_budgeted"),
        M.round_double("ts", 2).alias("total_spent_budgeted"),
        M.round_double(income - total_spent, 2).alias("net_remaining"),
        # unrounded helpers for warnings
        disc.alias("_disc"), remaining.alias("_remaining"), total_spent.alias("_spent"))


def budget_warnings(overview: DataFrame, budget_cats: DataFrame, settings: DataFrame) -> DataFrame:
    """Warnings: info (no income set), danger (overspent) or warning (percent at or above the
    threshold), and one warning per over-budget category."""
    warn_pct = setting_value(settings, "discretionary_warning_percent", 80.0).scalar()
    o = overview
    info = o.filter(F.col("monthly_income") == 0).select(
        F.lit("info").alias("type"), F.lit(None).cast("long").alias("category_id"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("severity"))
    danger = o.filter(F.col("_remaining") < 0).select(
        F.lit("danger").alias("type"), F.lit(None).cast("long").alias("category_id"),
        F.abs("_remaining").alias("amount"), F.lit("high").alias("severity"))
    warning = o.filter((F.col("_remaining") >= 0) & (F.col("_disc") > 0)
                       & (F.col("_spent") / F.col("_disc") * 100 >= warn_pct)).select(
        F.lit("warning").alias("type"), F.lit(None).cast("long").alias("category_id"),
        (F.col("_spent") / F.col("_disc") * 100).alias("amount"), F.lit("medium").alias("severity"))
    over = budget_cats.filter(F.col("over_budget")).select(
        F.lit("warning").alias("type"), F.col("id").alias("category_id"),
        (F.col("spent").cast("decimal(18,2)") - F.col("budget_amount").cast("decimal(18,2)"))
        .cast("double").alias("amount"), F.lit(None).cast("string").alias("severity"))
    return info.unionByName(danger).unionByName(warning).unionByName(over)


def budget_health(overview: DataFrame) -> DataFrame:
    """Health label of the overview: Over Budget / Getting Tight / On Track / Healthy."""
    p = F.col("percent_used")
    return overview.select(
        "month",
        F.when(F.col("is_over"), F.lit("Over Budget")).when(p >= 80, F.lit("Getting Tight"))
        .when(p >= 50, F.lit("On Track")).otherwise(F.lit("Healthy")).alias("health"))


def method_allocation(templates: DataFrame, incomes: DataFrame) -> DataFrame:
    """Template categories priced against each owner's monthly income.

    ``incomes`` has (owner, method_id, monthly_income). The equi-join on ``method_id`` pairs
    each owner only with the categories of its chosen method (a fixed-size template).
    """
    t = templates.select("method_id", "position", "name", "type", "percent")
    return (incomes.join(F.broadcast(t), "method_id")
            .select("owner", "method_id", "position", "name", "type", "percent",
                    M.round_double(F.col("monthly_income") * (F.col("percent") / F.lit(100.0)), 2)
                    .alias("budget_amount")))


def method_overrides(allocation: DataFrame, overrides: DataFrame) -> DataFrame:
    """Amounts given by name replace the template's: ``overrides`` (owner, name, amount); of several for
    a name the largest counts, names that are not in the template are left out."""
    o = overrides.groupBy("owner", "name").agg(F.max("amount").alias("_amount"))
    return (allocation.join(o, ["owner", "name"], "left")
            .withColumn("budget_amount", F.coalesce("_amount", "budget_amount")).drop("_amount"))


def method_totals_by_type(allocation: DataFrame) -> DataFrame:
    """Per owner and type, the sum of the template amounts (exact cents)."""
    return allocation.groupBy("owner", "type").agg(F.sum(F.col("budget_amount").cast("decimal(20,2)")).cast("double").alias("total"))


def method_blend_actuals(allocation: DataFrame, spend: DataFrame, category_map: DataFrame) -> DataFrame:
    """Raise each template amount to the rounded actual monthly spend of the categories that
    map to it (``max(template, round(actual))``), matching either the mapped or the raw name.

    ``spend`` has (owner, spend_category, amount).
    """
    mapped = (spend.join(F.broadcast(category_map), spend.spend_category == category_map.spend_category, "left")
              .select("owner", spend.spend_category.alias("raw"),
                      F.coalesce("template_category", spend.spend_category).alias("mapped"),
                      F.floor(F.col("amount") + 0.5).cast("double").alias("rounded")))
    names = allocation.select("owner", "name").distinct()
    # first choice: the mapped name; when it is not a template category, the raw name
    by_mapped = mapped.join(names.withColumnRenamed("name", "mapped"), ["owner", "mapped"], "left_semi") \
        .select("owner", F.col("mapped").alias("name"), "rounded")
    raw_only = (mapped.join(names.withColumnRenamed("name", "mapped"), ["owner", "mapped"], "left_anti")
                .join(names.withColumnRenamed("name", "raw"), ["owner", "raw"], "left_semi")
                .select("owner", F.col("raw").alias("name"), "rounded"))
    actual = by_mapped.unionByName(raw_only).groupBy("owner", "name").agg(F.max("rounded").alias("actual"))
    return (allocation.join(actual, ["owner", "name"], "left")
            .withColumn("adjusted_amount",
                        F.greatest(F.col("budget_amount"), F.coalesce("actual", F.col("budget_amount")))))


def allocation_percent(blended: DataFrame, incomes: DataFrame) -> DataFrame:
    """Share of income allocated after blending, as a whole percent (half rounds up)."""
    tot = blended.groupBy("owner").agg(F.sum(F.col("adjusted_amount").cast("decimal(20,2)")).cast("double").alias("allocated"))
    return (tot.join(incomes.select("owner", "monthly_income"), "owner")
            .select("owner", "allocated",
                    F.when(F.col("monthly_income") != 0,
                           F.floor(F.col("allocated") / F.col("monthly_income") * 100 + 0.5))
                    .otherwise(F.lit(0)).cast("long").alias("allocated_percent")))


def insight_cards(summary: DataFrame, category_status: DataFrame, overview: DataFrame) -> DataFrame:
    """Dashboard insight cards as rows (card, subject, value, count): monthly summary, open
    categorisation work, worst over-budget category, closest to its limit (80-100 %), top
    spending category, number of healthy budgets (< 50 %), activity, and the discretionary
    budget state. Each card is a filter plus a top-1 (``max_by``), combined by union."""
    s = summary
    cs = category_status
    budgeted = F.col("budget_amount") > 0
    pct = F.col("budget_percent")
    net = s.select(F.lit("Monthly Summary").alias("card"),
                   F.when(F.col("net") >= 0, F.lit("net savings")).otherwise(F.lit("net deficit")).alias("subject"),
                   F.abs("net").alias("value"), F.lit(None).cast("long").alias("count"))
    uncat = s.filter(F.col("uncategorized") > 0).select(
        F.lit("Action Required").alias("card"), F.lit("uncategorized").alias("subject"),
        F.lit(None).cast("double").alias("value"), F.col("uncategorized").alias("count"))

    def top1(df, card, value_col, order_col):
        g = df.agg(F.max_by(F.struct(F.col("name"), F.col(value_col).alias("v")),
                            F.struct(F.col(order_col), -F.col("id"))).alias("t"))
        return g.filter(F.col("t").isNotNull()).select(F.lit(card).alias("card"), F.col("t.name").alias("subject"),
                                                       F.col("t.v").alias("value"), F.lit(None).cast("long").alias("count"))

    over = top1(cs.filter(budgeted & (pct >= 100)), "Budget Alert", "budget_percent", "budget_percent")
    near = top1(cs.filter(budgeted & (pct >= 80) & (pct < 100)), "Budget Warning", "budget_percent", "budget_percent")
    top = top1(cs.filter(F.col("spent") > 0), "Top Spending", "spent", "spent")
    healthy = (cs.filter(budgeted & (pct < 50)).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
               .select(F.lit("On Track").alias("card"), F.lit("healthy budgets").alias("subject"),
                       F.lit(None).cast("double").alias("value"), F.col("n").alias("count")))
    activity = s.select(F.lit("Activity").alias("card"), F.lit("total transactions").alias("subject"),
                        F.lit(None).cast("double").alias("value"), F.col("total_transactions").alias("count"))
    o = overview.filter(F.col("income_is_set"))
    disc = o.select(
        F.when(F.col("is_over"), F.lit("Spending Alert"))
        .when(F.col("percent_used") >= 80, F.lit("Budget Warning"))
        .when((F.col("discretionary_budget") > 0) & (F.col("percent_used") < 50), F.lit("Budget Status"))
        .alias("card"),
        F.lit("discretionary").alias("subject"),
        F.when(F.col("is_over"), F.col("total_spent")).otherwise(F.col("percent_used")).alias("value"),
        F.lit(None).cast("long").alias("count")).filter(F.col("card").isNotNull())
    return (net.unionByName(uncat).unionByName(over).unionByName(near).unionByName(top)
            .unionByName(healthy).unionByName(activity).unionByName(disc))
