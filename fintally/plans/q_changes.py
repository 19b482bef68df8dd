"""Registered queries: rules and bulk ledger mutation (§2.7) plus the import dedupe (§2.1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.operators import changes as CH
from fintally.operators import ledger_store as LS
from fintally.operators import rules as RU
from fintally.plans import views as V
from fintally.plans.registry import register
from fintally.session import scratch_dir

_RULES_RANKED = """
rr AS (SELECT r.*, row_number() OVER (ORDER BY r.priority DESC, r.created_at, r.id) AS rk,
              CASE WHEN len(string_split(lower(r.pattern), ',')) = 2
                   THEN TRY_CAST(trim(string_split(lower(r.pattern), ',')[1]) AS DOUBLE) END AS lo,
              CASE WHEN len(string_split(lower(r.pattern), ',')) = 2
                   THEN TRY_CAST(trim(string_split(lower(r.pattern), ',')[2]) AS DOUBLE) END AS hi
       FROM v_rules r JOIN v_categories c ON r.category_id = c.id WHERE r.is_active),
best AS (SELECT t.id, MIN(rr.rk) AS rk FROM v_ledger t JOIN rr ON
           (rr.rule_type = 'merchant_contains' AND contains(lower(t.merchant), lower(rr.pattern)))
        OR (rr.rule_type = 'merchant_exact' AND lower(t.merchant) = lower(rr.pattern))
        OR (rr.rule_type = 'description_contains' AND contains(lower(coalesce(t.description, '')), lower(rr.pattern)))
        OR (rr.rule_type = 'amount_range' AND rr.lo IS NOT NULL AND rr.hi IS NOT NULL
            AND CAST(ABS(t.amount) AS DOUBLE) >= rr.lo AND CAST(ABS(t.amount) AS DOUBLE) <= rr.hi)
        GROUP BY t.id)"""


@register("rules_match_parts", """
WITH r AS (SELECT r.* FROM v_part_rules r JOIN v_categories c ON c.id = r.category_id WHERE r.is_active),
best AS (SELECT t.id, r.category_id, r.id AS rule_id FROM v_ledger t JOIN r ON
    CASE rule_type WHEN 'merchant_contains' THEN contains(lower(t.merchant), lower(pattern)) WHEN 'merchant_exact' THEN lower(t.merchant) = lower(pattern)
         WHEN 'description_contains' THEN contains(lower(coalesce(t.description, '')), lower(pattern))
         ELSE abs(t.amount) BETWEEN CAST(split_part(pattern, ',', 1) AS DOUBLE) AND CAST(split_part(pattern, ',', 2) AS DOUBLE) END
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY r.priority DESC, r.id) = 1)
SELECT t.id, best.category_id AS rule_category_id, best.rule_id FROM v_ledger t LEFT JOIN best ON best.id = t.id""")
def q_rules_match_parts(spark, sf):
    """As many rules as there are parts, a quarter of them amount ranges."""
    return RU.rules_match(V.ledger(spark, sf), V.part_rules(spark, sf), V.categories(spark)).select("id", "rule_category_id", "rule_id")


@register("rules_match", f"""
WITH {_RULES_RANKED}
SELECT t.id, rr.category_id AS rule_category_id, rr.id AS rule_id
FROM v_ledger t LEFT JOIN best ON t.id = best.id LEFT JOIN rr ON rr.rk = best.rk""")
def q_rules_match(spark, sf):
    return RU.rules_match(V.ledger(spark, sf), V.rules(spark), V.categories(spark)) \
        .select("id", "rule_category_id", "rule_id")


@register("rules_apply_uncategorized", f"""
WITH {_RULES_RANKED}
SELECT t.id, CASE WHEN t.category_id IS NULL AND rr.category_id IS NOT NULL AND rr.category_id <> 0
                  THEN rr.category_id ELSE t.category_id END AS category_id,
       (t.category_id IS NULL AND rr.category_id IS NOT NULL AND rr.category_id <> 0) AS rule_applied
FROM v_ledger t LEFT JOIN best ON t.id = best.id LEFT JOIN rr ON rr.rk = best.rk""")
def q_rules_apply(spark, sf):
    return RU.rules_apply_uncategorized(V.ledger(spark, sf), V.rules(spark), V.categories(spark)) \
        .select("id", "category_id", "rule_applied")


_FRESH_SQL = """fresh AS (SELECT * FROM v_batch b WHERE NOT EXISTS (
    SELECT 1 FROM v_existing e WHERE e.date = b.date AND e.amount = b.amount AND e.merchant = b.merchant))"""


@register("ledger_dedupe", f"""
WITH {_FRESH_SQL}
SELECT date, CAST(amount AS DOUBLE) AS amount, merchant,
       arg_min(file, (file, line, description)) AS file, arg_min(line, (file, line, description)) AS line,
       arg_min(description, (file, line, description)) AS description, COUNT(*) AS copies_in_batch
FROM fresh GROUP BY date, amount, merchant""")
def q_ledger_dedupe(spark, sf):
    new, _ = CH.ledger_dedupe(V.existing_ledger(spark, sf), V.import_batch(spark, sf))
    return new.select("date", M.out("amount").alias("amount"), "merchant", "file", "line", "description",
                      "copies_in_batch")


@register("ledger_dedupe_duplicates", f"""
WITH {_FRESH_SQL},
firsts AS (SELECT date, amount, merchant, arg_min(file, (file, line, description)) AS file,
                  arg_min(line, (file, line, description)) AS line FROM fresh GROUP BY 1, 2, 3)
SELECT 'existing' AS dup_reason, file, line, date, CAST(amount AS DOUBLE) AS amount, merchant FROM v_batch b WHERE EXISTS (
   SELECT 1 FROM v_existing e WHERE e.date = b.date AND e.amount = b.amount AND e.merchant = b.merchant)
UNION ALL
SELECT 'in_batch', file, line, date, CAST(amount AS DOUBLE), merchant FROM fresh f WHERE NOT EXISTS (
   SELECT 1 FROM firsts x WHERE x.date = f.date AND x.amount = f.amount AND x.merchant = f.merchant
     AND x.file = f.file AND x.line = f.line)""")
def q_ledger_dedupe_dups(spark, sf):
    _, dups = CH.ledger_dedupe(V.existing_ledger(spark, sf), V.import_batch(spark, sf))
    return dups.select("dup_reason", "file", "line", "date", M.out("amount").alias("amount"), "merchant")


@register("import_report", f"""
WITH {_FRESH_SQL},
new AS (SELECT arg_min(file, (file, line, description)) AS file FROM fresh GROUP BY date, amount, merchant),
p AS (SELECT file, COUNT(*) AS parsed FROM v_batch GROUP BY file),
a AS (SELECT file, COUNT(*) AS added FROM new GROUP BY file)
SELECT p.file, p.parsed, COALESCE(a.added, 0) AS added, p.parsed - COALESCE(a.added, 0) AS duplicates, 0 AS errors
FROM p LEFT JOIN a ON p.file = a.file""")
def q_import_report(spark, sf):
    batch = V.import_batch(spark, sf)
    new, _ = CH.ledger_dedupe(V.existing_ledger(spark, sf), batch)
    return CH.import_report(batch, new)


@register("import_categorize", f"""
WITH {_FRESH_SQL}, {_RULES_RANKED},
new AS (SELECT arg_min(file, (file, line, description)) AS file, arg_min(line, (file, line, description)) AS line
        FROM fresh GROUP BY date, amount, merchant),
p AS (SELECT file, COUNT(*) AS parsed FROM v_batch GROUP BY file),
a AS (SELECT file, COUNT(*) AS added, COUNT(best.rk) AS categorized FROM new LEFT JOIN best ON best.id = new.line GROUP BY file)
SELECT p.file, p.parsed, COALESCE(a.added, 0) AS added, p.parsed - COALESCE(a.added, 0) AS duplicates, 0 AS errors,
       COALESCE(a.categorized, 0) AS categorized
FROM p LEFT JOIN a ON p.file = a.file""")
def q_import_categorize(spark, sf):
    """Import, de-duplicate, categorise by rules, report."""
    batch = V.import_batch(spark, sf)
    new, _ = CH.ledger_dedupe(V.existing_ledger(spark, sf), batch)
    return CH.import_report(batch, RU.rules_match(new, V.rules(spark), V.categories(spark)))


@register("split_unsplit", """
SELECT t.id, t.is_split AND t.id % 2 = 1 AS is_split,
       (SELECT COUNT(*) FROM v_splits s WHERE s.transaction_id = t.id AND t.id % 2 = 1) AS lines
FROM (SELECT id, id IN (SELECT transaction_id FROM v_splits) AS is_split FROM v_ledger) t""")
def q_split_unsplit(spark, sf):
    splits = V.splits(spark, sf)
    parents = splits.select(F.col("transaction_id").alias("id"), F.lit(True).alias("_p")).distinct()
    led = V.ledger(spark, sf).join(parents, "id", "left").withColumn("is_split", F.coalesce("_p", F.lit(False))).drop("_p")
    t, left = CH.split_unsplit(led, splits, parents.filter(F.col("id") % 2 == 0).select("id"))
    n = left.groupBy(F.col("transaction_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    return t.select("id", "is_split").join(n, "id", "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))


@register("validate_unique_names", """
SELECT p_partkey AS id, COUNT(*) OVER (PARTITION BY lower(trim(p_name))) = 1 AS valid FROM part""")
def q_validate_unique_names(spark, sf):
    parts = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return CH.validate_unique_names(parts).select("id", "valid")


@register("contribution_delete", """
SELECT goal_id, CAST(SUM(amount) AS DOUBLE) AS current_amount, COUNT(*) AS contributions FROM v_contributions
WHERE id % 5 <> 0 GROUP BY goal_id""")
def q_contribution_delete(spark, sf):
    contrib = V.contributions(spark, sf)
    gone = contrib.filter(F.col("id") % 5 == 0).select("id")
    left = CH.hard_delete(contrib, gone.unionByName(gone))
    return left.groupBy("goal_id").agg(M.out(F.sum("amount")).alias("current_amount"), F.count(F.lit(1)).alias("contributions"))


_LATEST_CH = """lc AS (SELECT id, field, arg_max(value, (seq, value)) AS value FROM v_changes
         WHERE field IN ('category_id', 'account_id', 'description', '__delete__') GROUP BY id, field)"""


@register("apply_changes", f"""
WITH {_LATEST_CH}
SELECT t.id,
       COALESCE(TRY_CAST((SELECT value FROM lc WHERE lc.id = t.id AND field = 'category_id') AS BIGINT), t.category_id) AS category_id,
       COALESCE(TRY_CAST((SELECT value FROM lc WHERE lc.id = t.id AND field = 'account_id') AS BIGINT), t.account_id) AS account_id,
       COALESCE((SELECT value FROM lc WHERE lc.id = t.id AND field = 'description'), t.description) AS description,
       t.merchant
FROM v_ledger t WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.id = t.id AND lc.field = '__delete__')""")
def q_apply_changes(spark, sf):
    out = CH.apply_changes(V.ledger(spark, sf), V.change_feed(spark, sf), "id",
                           ["category_id", "account_id", "description"])
    return out.select("id", "category_id", "account_id", "description", "merchant")


_CHANGED_LEDGER = f"""
WITH {_LATEST_CH},
now AS (SELECT t.id, t.date, t.amount, t.merchant,
               COALESCE(TRY_CAST((SELECT value FROM lc WHERE lc.id = t.id AND field = 'category_id') AS BIGINT), t.category_id) AS category_id,
               COALESCE(TRY_CAST((SELECT value FROM lc WHERE lc.id = t.id AND field = 'account_id') AS BIGINT), t.account_id) AS account_id,
               COALESCE((SELECT value FROM lc WHERE lc.id = t.id AND field = 'description'), t.description) AS description
        FROM v_ledger t WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.id = t.id AND lc.field = '__delete__'))"""


def _changed_store(spark, sf) -> str:
    """A stored ledger of two batches, after the change feed has been applied, twice."""
    path, led = scratch_dir(spark, "ledger-store"), V.ledger(spark, sf)
    for b in (0, 1):
        LS.append_batch(led.filter(F.col("id") % 2 == b), path, f"b{b}")
    for _ in range(2):
        LS.change_ledger(spark, path, V.change_feed(spark, sf), ["category_id", "account_id", "description"], "f0")
    return path


@register("apply_changes_stored", f"""{_CHANGED_LEDGER}
SELECT id, date, CAST(amount AS DOUBLE) AS amount, category_id, account_id, description, merchant FROM now""")
def q_apply_changes_stored(spark, sf):
    rows = LS.stored_ledger(spark, _changed_store(spark, sf))
    return rows.select("id", "date", M.out("amount").alias("amount"), "category_id", "account_id", "description", "merchant")


@register("rollup_after_changes", f"""{_CHANGED_LEDGER}
SELECT strftime(date, '%Y-%m') AS month, category_id, CAST(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS income,
       CAST(SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS expenses, COUNT(*) AS n FROM now GROUP BY 1, 2""")
def q_rollup_after_changes(spark, sf):
    kept = LS.rollup(spark, _changed_store(spark, sf))
    return kept.select("month", "category_id", M.out("income").alias("income"), M.out("expenses").alias("expenses"), F.col("rows").alias("n"))


def _assignments(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 16 + 1).alias("category_id"),
                     F.col("l_linenumber").alias("seq"))


@register("bulk_categorize_report", """
WITH a AS (SELECT l_orderkey AS id, arg_max(l_partkey % 16 + 1, (l_linenumber, l_partkey % 16 + 1)) AS category_id
           FROM lineitem GROUP BY l_orderkey)
SELECT a.id, a.category_id,
       (a.id IN (SELECT id FROM v_ledger) AND a.category_id IN (SELECT id FROM v_categories)) AS success
FROM a""")
def q_bulk_categorize_report(spark, sf):
    _, rep = CH.bulk_categorize(V.ledger(spark, sf), _assignments(spark, sf), V.categories(spark))
    return rep


@register("bulk_categorize", """
WITH a AS (SELECT l_orderkey AS id, arg_max(l_partkey % 16 + 1, (l_linenumber, l_partkey % 16 + 1)) AS category_id
           FROM lineitem GROUP BY l_orderkey),
ok AS (SELECT * FROM a WHERE category_id IN (SELECT id FROM v_categories))
SELECT t.id, COALESCE(ok.category_id, t.category_id) AS category_id, t.merchant FROM v_ledger t LEFT JOIN ok ON t.id = ok.id""")
def q_bulk_categorize(spark, sf):
    out, _ = CH.bulk_categorize(V.ledger(spark, sf), _assignments(spark, sf), V.categories(spark))
    return out.select("id", "category_id", "merchant")


@register("soft_delete", """
SELECT a.id, a.is_active AND a.id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS is_active
FROM v_accounts a""")
def q_soft_delete(spark, sf):
    keys = V.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("id"))
    return CH.soft_delete(V.accounts(spark, sf), keys).select("id", "is_active")


@register("hard_delete", """
SELECT 'goals' AS tbl, COUNT(*) AS n FROM v_goals WHERE target_amount <> 0
UNION ALL
SELECT 'contributions', COUNT(*) FROM v_contributions
WHERE goal_id NOT IN (SELECT id FROM v_goals WHERE target_amount = 0)""")
def q_hard_delete(spark, sf):
    goals = V.goals(spark, sf)
    keys = goals.filter(F.col("target_amount") == 0).select("id")
    g = CH.hard_delete(goals, keys)
    c = CH.delete_children(V.contributions(spark, sf), keys, "goal_id")
    return (g.agg(F.count(F.lit(1)).alias("n")).select(F.lit("goals").alias("tbl"), "n")
            .unionByName(c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("contributions").alias("tbl"), "n")))


@register("delete_category_guarded", """
SELECT k.id, COALESCE(u.n, 0) AS txn_count, COALESCE(u.n, 0) = 0 AS deleted
FROM (SELECT DISTINCT category_id AS id FROM v_bills WHERE category_id IS NOT NULL
      UNION SELECT id + 14 FROM v_categories WHERE budget_amount = 0) k
LEFT JOIN (SELECT category_id, COUNT(*) AS n FROM v_ledger WHERE category_id IS NOT NULL GROUP BY 1) u
  ON u.category_id = k.id""")
def q_delete_category_guarded(spark, sf):
    cats = V.categories(spark)
    keys = (V.bills(spark, sf).filter(F.col("category_id").isNotNull()).select(F.col("category_id").alias("id"))
            .unionByName(cats.filter(F.col("budget_amount") == 0).select((F.col("id") + 14).alias("id"))))
    _, outcome = CH.delete_category_guarded(cats, V.ledger(spark, sf), keys)
    return outcome.select("id", "txn_count", "deleted")


@register("validate_rules", """
SELECT r.id, array_to_string(list_filter([
         CASE WHEN r.rule_type NOT IN ('merchant_contains', 'merchant_exact', 'description_contains', 'amount_range') THEN 'invalid_rule_type' END,
         CASE WHEN r.category_id NOT IN (SELECT id FROM v_categories) THEN 'unknown_category' END,
         CASE WHEN r.rule_type = 'amount_range' AND (len(string_split(r.pattern, ',')) <> 2 OR TRY_CAST(split_part(r.pattern, ',', 1) AS DOUBLE) IS NULL
              OR TRY_CAST(split_part(r.pattern, ',', 2) AS DOUBLE) IS NULL) THEN 'invalid_range' END], lambda x: x IS NOT NULL), ',') AS errors
FROM v_part_rules r""")
def q_validate_rules(spark, sf):
    return CH.validate_rules(V.part_rules(spark, sf), V.categories(spark)).select("id", F.array_join("errors", ",").alias("errors"))


@register("validate_accounts", """
SELECT id, array_to_string(list_filter([CASE WHEN account_type NOT IN ('checking', 'savings', 'credit', 'investment') THEN 'invalid_account_type' END,
                                        CASE WHEN trim(name) = '' THEN 'blank_name' END], lambda x: x IS NOT NULL), ',') AS errors FROM v_accounts""")
def q_validate_accounts(spark, sf):
    return CH.validate_accounts(V.accounts(spark, sf)).select("id", F.array_join("errors", ",").alias("errors"))


@register("validate_refs", """
SELECT b.id, array_to_string(list_filter([
         CASE WHEN b.frequency NOT IN ('daily', 'weekly', 'biweekly', 'monthly', 'quarterly', 'yearly', 'annually')
              THEN 'invalid_frequency' END,
         CASE WHEN b.category_id IS NOT NULL AND b.category_id NOT IN (SELECT id FROM v_categories)
              THEN 'unknown_category' END,
         CASE WHEN b.account_id IS NOT NULL AND b.account_id NOT IN (SELECT id FROM v_accounts WHERE is_active)
              THEN 'unknown_account' END], lambda x: x IS NOT NULL), ',') AS errors
FROM v_bills b""")
def q_validate_refs(spark, sf):
    bills = V.bills(spark, sf)
    cats = V.categories(spark).select(F.col("id").alias("category_id"), F.lit(True).alias("_cat"))
    accs = V.accounts(spark, sf).filter("is_active").select(F.col("id").alias("account_id"), F.lit(True).alias("_acc"))
    j = bills.join(F.broadcast(cats), "category_id", "left").join(accs, "account_id", "left")
    checked = CH.validate_refs(j, {
        "invalid_frequency": ~F.col("frequency").isin("daily", "weekly", "biweekly", "monthly", "quarterly",
                                                      "yearly", "annually"),
        "unknown_category": F.col("category_id").isNotNull() & F.col("_cat").isNull(),
        "unknown_account": F.col("account_id").isNotNull() & F.col("_acc").isNull(),
    })
    return checked.select("id", F.array_join("errors", ",").alias("errors"))


@register("split_validate", """
SELECT s.transaction_id, s.split_count, CAST(s.split_total AS DOUBLE) AS split_total,
       CAST(ABS(t.amount) AS DOUBLE) AS original, t.id IS NOT NULL AS parent_exists,
       t.id IS NOT NULL AND ABS(s.split_total - ABS(t.amount)) <= 0.01 AS valid
FROM (SELECT transaction_id, COUNT(*) AS split_count, SUM(ABS(amount)) AS split_total FROM v_splits GROUP BY 1) s
LEFT JOIN v_ledger t ON t.id = s.transaction_id""")
def q_split_validate(spark, sf):
    v = CH.split_validate(V.ledger(spark, sf), V.splits(spark, sf))
    return v.select("transaction_id", "split_count", M.out("split_total").alias("split_total"),
                    M.out("original").alias("original"), "parent_exists", "valid")


_VALID_PARENTS = """vp AS (SELECT s.transaction_id AS id FROM (SELECT transaction_id, SUM(ABS(amount)) AS st FROM v_splits GROUP BY 1) s
   JOIN v_ledger t ON t.id = s.transaction_id WHERE ABS(s.st - ABS(t.amount)) <= 0.01)"""


def _old_splits(spark, sf):
    """Lines that every split parent had before: replaced only where the new ones are valid."""
    return V.splits(spark, sf).withColumn("id", F.col("id") + 1_000_000_000)


@register("split_apply", f"""
WITH {_VALID_PARENTS}
SELECT t.id, t.is_split OR t.id IN (SELECT id FROM vp) AS is_split,
       CASE WHEN t.id IN (SELECT id FROM vp) THEN NULL ELSE t.category_id END AS category_id
FROM v_ledger t""")
def q_split_apply(spark, sf):
    old = _old_splits(spark, sf)
    t, _ = CH.split_apply(V.ledger(spark, sf), old, V.splits(spark, sf))
    return t.select("id", "is_split", "category_id")


@register("split_apply_lines", f"""
WITH {_VALID_PARENTS}
SELECT id, transaction_id, category_id, CAST(ABS(amount) AS DOUBLE) AS amount FROM v_splits
WHERE transaction_id IN (SELECT id FROM vp)
UNION ALL SELECT id + 1000000000, transaction_id, category_id, CAST(amount AS DOUBLE) FROM v_splits
WHERE transaction_id NOT IN (SELECT id FROM vp)""")
def q_split_apply_lines(spark, sf):
    old = _old_splits(spark, sf)
    _, s = CH.split_apply(V.ledger(spark, sf), old, V.splits(spark, sf))
    return s.select("id", "transaction_id", "category_id", M.out("amount").alias("amount"))


@register("split_remaining", """
SELECT s.transaction_id, s.last_id, CAST(ROUND(ABS(t.amount) - s.used, 2) AS DOUBLE) AS remaining,
       CAST(ROUND(s.last_amount + ROUND(ABS(t.amount) - s.used, 2), 2) AS DOUBLE) AS last_filled
FROM (SELECT transaction_id, SUM(amount) AS used, arg_max(amount, id) AS last_amount, MAX(id) AS last_id
      FROM v_splits GROUP BY 1) s JOIN v_ledger t ON t.id = s.transaction_id""")
def q_split_remaining(spark, sf):
    r = CH.split_remaining(V.ledger(spark, sf), V.splits(spark, sf))
    return r.select("transaction_id", "last_id", M.out("remaining").alias("remaining"),
                    M.out("last_filled").alias("last_filled"))


@register("template_upsert", """
WITH j AS (SELECT c.id, COALESCE(c.name, t.name) AS name, c.budget_amount, t.budget_amount AS budget, t.position
           FROM v_supplier_categories c FULL OUTER JOIN v_template t ON c.name = t.name)
SELECT COALESCE(id, (SELECT MAX(id) FROM v_supplier_categories) + row_number() OVER (PARTITION BY id IS NULL ORDER BY position)) AS id,
       name, CAST(COALESCE(CAST(budget AS DECIMAL(18,2)), budget_amount, 0) AS DOUBLE) AS budget_amount
FROM j""")
def q_template_upsert(spark, sf):
    out = CH.template_upsert(V.supplier_categories(spark, sf), V.template_parts(spark, sf))
    return out.select("id", "name", M.out("budget_amount").alias("budget_amount"))


@register("mark_flags", """
SELECT t.id, t.is_anomaly OR t.id % 89 = 0 AS is_anomaly, t.is_recurring OR b.g IS NOT NULL AS is_recurring,
       b.g AS recurring_group_id
FROM v_ledger t LEFT JOIN (SELECT merchant, MIN(id) AS g FROM v_ledger GROUP BY 1 HAVING COUNT(*) >= 20) b ON t.merchant = b.merchant""")
def q_mark_flags(spark, sf):
    led = V.ledger(spark, sf)
    busy = led.groupBy("merchant").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id")).filter("n >= 20")
    rec = led.select("id", "merchant").join(busy, "merchant").select("id", "group_id")
    anom = led.filter(F.col("id") % 89 == 0).select("id")
    out = CH.mark_flags(led, rec, anom.unionByName(anom))  # repeated ids count once
    return out.select("id", "is_anomaly", "is_recurring", "recurring_group_id")
