"""Ledger mutation in bulk: de-duplication, keyed change feeds, deletes, splits, flags.

Updates are expressed as change-feed frames joined to the base table (last write wins),
never as per-row statements. Every per-key "first"/"latest" choice is a ``min_by``/
``max_by`` aggregate, which Spark combines map-side, so a key repeated a million times
(one hot group of copies) is reduced inside each task before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.schema import ACCOUNT_TYPES, MONEY, RULE_TYPES

DEDUPE_KEYS = ("date", "amount", "merchant")


def _py_money_text(c) -> F.Column:
    """The text Python's str(float) gives for a cents-exact amount: the 2-decimal text with
    one trailing zero dropped ('100.00' -> '100.0', '-45.90' -> '-45.9', '-45.99' stays),
    in plain (not scientific) notation for any size."""
    t = F.col(c).cast("decimal(20,2)").cast("string")
    return F.regexp_replace(t, "0$", "")


def dedupe_key(*cols) -> F.Column:
    """sha256 of 'date|amount|merchant' with the amount spelled as Python prints a float."""
    parts = [_py_money_text(c) if c == "amount" else F.col(c).cast("string") for c in (cols or DEDUPE_KEYS)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def ledger_dedupe(existing: DataFrame, batch: DataFrame, keys=DEDUPE_KEYS, order=("file", "line")):
    """Split an import batch into (new, duplicates).

    ``new``: the first row (by ``order``) of every key that is not already in ``existing``.
    ``duplicates``: every other batch row, tagged ``dup_reason`` = 'existing' or 'in_batch'.
    The first row per key is a ``min_by`` aggregate (partial, skew-safe), not a window.
    """
    keys, order = list(keys), list(order)
    known = existing.select(*keys).distinct()
    fresh = batch.join(known, keys, "left_anti")
    payload = [c for c in batch.columns if c not in keys]
    first = (fresh.groupBy(*keys)
             .agg(F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload if c not in order]))
                  .alias("_first"), F.count(F.lit(1)).alias("copies_in_batch")))
    new = first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order],
                       *[F.col(f"_first.{c}").alias(c) for c in payload if c not in order], "copies_in_batch")
    in_existing = batch.join(known, keys, "left_semi").withColumn("dup_reason", F.lit("existing"))
    firsts = new.select(*keys, *order)
    in_batch = fresh.join(firsts, [*keys, *order], "left_anti").withColumn("dup_reason", F.lit("in_batch"))
    return new, in_existing.unionByName(in_batch)


def import_report(batch: DataFrame, new: DataFrame, rejected: DataFrame | None = None, by: str = "file") -> DataFrame:
    """Per file: rows parsed, added (new), duplicates and errors, and how many of the added rows a rule
    has categorised if ``new`` went through ``rules_match``."""
    parsed = batch.groupBy(by).agg(F.count(F.lit(1)).alias("parsed"))
    added = new.groupBy(by).agg(F.count(F.lit(1)).alias("added"))
    rep = parsed.join(added, by, "left")
    if "rule_category_id" in new.columns:
        done = new.groupBy(by).agg(F.count("rule_category_id").alias("categorized"))
        rep = rep.join(done, by, "left").withColumn("categorized", F.coalesce("categorized", F.lit(0).cast("long")))
    if rejected is not None:
        errs = rejected.groupBy(by).agg(F.count(F.lit(1)).alias("errors"))
        rep = rep.join(errs, by, "full_outer")
    else:
        rep = rep.withColumn("errors", F.lit(0).cast("long"))
    return rep.select(by, F.coalesce("parsed", F.lit(0)).alias("parsed"),
                      F.coalesce("added", F.lit(0)).alias("added"),
                      (F.coalesce("parsed", F.lit(0)) - F.coalesce("added", F.lit(0))).alias("duplicates"),
                      F.coalesce("errors", F.lit(0)).alias("errors"), *[c for c in ("categorized",) if c in rep.columns])


def latest_changes(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """(key, field, value, ok): per (key, field) the value of the highest ``seq`` (of equal seqs the
    larger value). A NULL value means "unchanged" and never wins; a field that is not in ``allowed``
    is left out. ``ok`` is false for a value that the column's type does not take."""
    dtypes = dict(base.dtypes)
    ch = changes.filter((F.col("field").isin(*allowed) & F.col("value").isNotNull()) | (F.col("field") == "__delete__"))
    latest = (ch.groupBy(key, "field").agg(F.max(F.struct("seq", "value")).alias("_w"))
              .select(key, "field", F.col("_w.value").alias("value")))
    casts = F.coalesce(*[F.when(F.col("field") == c, F.expr(f"try_cast(value AS {dtypes[c]})").isNotNull()) for c in allowed if c in dtypes], F.lit(True))
    return latest.withColumn("ok", casts)


def rejected_changes(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """(key, field, value, error) of changes that are not applied: 'field' is not in ``allowed``, or the
    'value' does not cast to the column's type."""
    bad = latest_changes(base, changes, key, allowed).filter(~F.col("ok")).select(key, "field", "value", F.lit("value").alias("error"))
    other = changes.filter(~F.coalesce(F.col("field").isin(*allowed, "__delete__"), F.lit(False)))
    return bad.unionByName(other.select(key, "field", "value", F.lit("field").alias("error")))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Apply a long-form change feed (key, field, value, seq) to ``base``.

    The winning values of ``latest_changes`` are cast to the columns' types; those of
    ``rejected_changes`` leave the column as it is. A ``field`` of '__delete__' removes the key.
    """
    latest = latest_changes(base, changes, key, allowed).filter("ok")
    deletes = latest.filter(F.col("field") == "__delete__").select(key)
    wide = (latest.filter(F.col("field") != "__delete__").groupBy(key)
            .pivot("field", allowed).agg(F.first("value")))
    dtypes = dict(base.dtypes)
    renamed = wide.select(key, *[F.col(c).alias(f"_new_{c}") for c in allowed if c in wide.columns])
    j = base.join(deletes, key, "left_anti").join(renamed, key, "left")
    cols = []
    for c in base.columns:
        if c in allowed and f"_new_{c}" in j.columns:
            cols.append(F.coalesce(F.expr(f"try_cast(`_new_{c}` AS {dtypes[c]})"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def bulk_categorize(txns: DataFrame, assignments: DataFrame, categories: DataFrame):
    """Assign (id, category_id) pairs; returns (txns', report) with success/failed per id.

    Failures: unknown transaction id or unknown category. An id that is assigned more than once
    counts once: with the highest ``seq`` if the column is there, else the largest category id.
    """
    cats = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_cat_ok"))
    ids = txns.select("id", F.lit(True).alias("_txn_ok"))
    order = ["seq", "category_id"] if "seq" in assignments.columns else ["category_id"]
    a = (assignments.groupBy("id").agg(F.max(F.struct(*order)).alias("_w"))
         .select("id", F.col("_w.category_id").alias("category_id")))
    rep = (a.join(ids, "id", "left").join(cats, "category_id", "left")
           .select("id", "category_id",
                   (F.coalesce("_txn_ok", F.lit(False)) & F.coalesce("_cat_ok", F.lit(False))).alias("success")))
    ok = rep.filter("success").select("id", F.col("category_id").alias("_new_cat"))
    out = (txns.join(ok, "id", "left")
           .withColumn("category_id", F.coalesce("_new_cat", "category_id")).drop("_new_cat"))
    return out, rep


def soft_delete(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """is_active = false for the given keys."""
    k = keys.select(key).distinct().withColumn("_del", F.lit(True))
    return (df.join(k, key, "left")
            .withColumn("is_active", F.col("is_active") & ~F.coalesce("_del", F.lit(False))).drop("_del"))


def hard_delete(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_children(children: DataFrame, keys: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Cascade: drop child rows whose ``fk`` points at a deleted key."""
    return children.join(keys.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def delete_category_guarded(categories: DataFrame, txns: DataFrame, keys: DataFrame):
    """Delete categories unless transactions reference them.

    Returns (categories', outcome) where outcome has (id, deleted, txn_count).
    """
    used = txns.filter(F.col("category_id").isNotNull()).groupBy(F.col("category_id").alias("id")) \
        .agg(F.count(F.lit(1)).alias("txn_count"))
    req = keys.select("id").distinct()
    outcome = (req.join(used, "id", "left")
               .select("id", F.coalesce("txn_count", F.lit(0)).alias("txn_count"))
               .withColumn("deleted", F.col("txn_count") == 0))
    gone = outcome.filter("deleted").select("id")
    return categories.join(gone, "id", "left_anti"), outcome


def validate_refs(rows: DataFrame, checks: dict) -> DataFrame:
    """Row-level validation; ``checks`` maps an error code to a boolean Column that is true
    when the row is invalid. Adds ``errors`` (array of codes) and ``valid``."""
    errs = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in checks.items()]))
    return rows.withColumn("errors", errs).withColumn("valid", F.size("errors") == 0)


def validate_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules with ``errors``: a type that is not known, a category that does not exist, an amount range whose pattern
    is not two numbers. A missing value is an error too."""
    cats = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_cat"))
    parts = F.split(F.lower("pattern"), ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    numbers = (F.size(parts) == 2) & number(0).isNotNull() & number(1).isNotNull()
    checked = validate_refs(rules.join(cats, "category_id", "left"), {
        "invalid_rule_type": ~F.coalesce(F.col("rule_type").isin(*RULE_TYPES), F.lit(False)),
        "unknown_category": F.col("_cat").isNull(),
        "invalid_range": (F.col("rule_type") == "amount_range") & ~F.coalesce(numbers, F.lit(False))})
    return checked.drop("_cat")


def validate_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts with ``errors``: a type that is not known, a blank name."""
    return validate_refs(accounts, {"invalid_account_type": ~F.coalesce(F.col("account_type").isin(*ACCOUNT_TYPES), F.lit(False)),
                                    "blank_name": F.length(F.trim(F.coalesce("name", F.lit("")))) == 0})


def validate_unique_names(df: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """``df`` with ``errors``: 'missing_name' for a null or blank name, 'duplicate_name' where another
    row has the same name (without regard to case), and ``valid``."""
    lower = F.lower(F.trim(name))
    shared = df.filter(F.length(lower) > 0).groupBy(lower.alias("_name")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = df.withColumn("_key", lower).join(shared.select(F.col("_name").alias("_key"), F.lit(True).alias("_shared")), "_key", "left")
    return validate_refs(marked, {"missing_name": F.coalesce(F.length("_key"), F.lit(0)) == 0,
                                  "duplicate_name": F.coalesce("_shared", F.lit(False))}).drop("_key", "_shared")


def mark_flags(txns: DataFrame, recurring: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Set is_recurring / recurring_group_id from (id, group_id) and is_anomaly from (id). Repeated ids
    count once (the largest group id)."""
    r = recurring.groupBy("id").agg(F.max("group_id").alias("_gid"), F.lit(True).alias("_rec"))
    a = anomalies.select("id").distinct().withColumn("_anom", F.lit(True))
    return (txns.join(r, "id", "left").join(a, "id", "left")
            .withColumn("is_recurring", F.col("is_recurring") | F.coalesce("_rec", F.lit(False)))
            .withColumn("recurring_group_id", F.coalesce("_gid", "recurring_group_id"))
            .withColumn("is_anomaly", F.col("is_anomaly") | F.coalesce("_anom", F.lit(False)))
            .drop("_gid", "_rec", "_anom"))


def split_validate(txns: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split parent: parent exists and | sum |line| - |amount| | <= 0.01."""
    s = splits.groupBy("transaction_id").agg(F.sum(F.abs("amount")).alias("split_total"),
                                             F.count(F.lit(1)).alias("split_count"))
    p = txns.select(F.col("id").alias("transaction_id"), F.abs("amount").alias("original"))
    j = s.join(p, "transaction_id", "left")
    diff = F.abs(F.col("split_total") - F.col("original"))
    return j.select("transaction_id", "split_count", "split_total", "original",
                    F.col("original").isNotNull().alias("parent_exists"),
                    (F.col("original").isNotNull() & (diff <= F.lit(0.01).cast("decimal(3,2)"))).alias("valid"))


def split_apply(txns: DataFrame, old_splits: DataFrame, new_splits: DataFrame):
    """Replace the splits of every parent with valid new splits.

    Returns (txns', splits'): parents get is_split = true and category NULL; their old
    split lines are replaced (amounts stored as absolute values).
    """
    v = split_validate(txns, new_splits).filter("valid").select(F.col("transaction_id").alias("id"))
    parents = v.withColumn("_split", F.lit(True))
    t = (txns.join(parents, "id", "left")
         .withColumn("is_split", F.col("is_split") | F.coalesce("_split", F.lit(False)))
         .withColumn("category_id", F.when(F.col("_split").isNotNull(), F.lit(None).cast("long"))
                     .otherwise(F.col("category_id")))
         .drop("_split"))
    keep_old = old_splits.join(v.select(F.col("id").alias("transaction_id")), "transaction_id", "left_anti")
    add_new = (new_splits.join(v.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
               .withColumn("amount", F.abs("amount").cast(MONEY)))
    return t, keep_old.unionByName(add_new.select(*old_splits.columns))


def split_unsplit(txns: DataFrame, splits: DataFrame, parents: DataFrame):
    """Remove the splits of ``parents`` and clear their flag (the category stays NULL)."""
    p = parents.select(F.col("id").alias("transaction_id")).distinct()
    s = splits.join(p, "transaction_id", "left_anti")
    t = (txns.join(p.select(F.col("transaction_id").alias("id"), F.lit(True).alias("_u")), "id", "left")
         .withColumn("is_split", F.col("is_split") & F.col("_u").isNull()).drop("_u"))
    return t, s


def split_remaining(txns: DataFrame, splits: DataFrame) -> DataFrame:
    """Per parent: |amount| - sum of lines (rounded to cents) and the amount the last line
    (highest id) would take if the remainder were filled into it."""
    agg = splits.groupBy("transaction_id").agg(
        F.sum("amount").alias("used"),
        F.max_by("amount", "id").alias("last_amount"), F.max("id").alias("last_id"))
    p = txns.select(F.col("id").alias("transaction_id"), F.abs("amount").alias("total"))
    rem = F.round(F.col("total") - F.col("used"), 2)
    return (agg.join(p, "transaction_id")
            .select("transaction_id", "last_id", rem.alias("remaining"),
                    F.round(F.col("last_amount") + rem, 2).alias("last_filled")))


def template_upsert(categories: DataFrame, template: DataFrame) -> DataFrame:
    """Create categories named in ``template`` (name, keywords, budget_amount) or update the
    keywords and budget of existing ones (matched on the exact name). New ids continue after
    the current maximum id, in template order (``position``)."""
    from pyspark.sql import Window

    t = template.select("name", F.col("keywords").alias("_kw"), F.col("budget_amount").alias("_budget"), "position")
    j = categories.join(t, "name", "full_outer")
    max_id = categories.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_rows = j.filter(F.col("id").isNull())
    # numbered in blocks of positions: a row's number is its place in its block behind all earlier blocks
    blk = F.floor(F.col("position") / 4096)
    blocks = new_rows.groupBy(blk.alias("_blk")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = (new_rows.withColumn("_blk", blk).join(blocks.select("_blk", earlier.alias("_before")), "_blk")
                .withColumn("id", max_id + F.col("_before") + F.row_number().over(Window.partitionBy("_blk").orderBy("position")))
                .drop("_blk", "_before"))
    old_rows = j.filter(F.col("id").isNotNull())
    both = old_rows.unionByName(numbered)
    return both.select(
        "id", "name",
        F.when(F.col("_kw").isNotNull(), F.split(F.col("_kw"), ",")).otherwise(F.col("keywords")).alias("keywords"),
        F.coalesce(F.col("_budget").cast(MONEY), F.col("budget_amount"), F.lit(0).cast(MONEY)).alias("budget_amount"))
