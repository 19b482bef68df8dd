"""Import dedupe with a hot group of copies, change feeds and splits on literal frames."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fintally.operators import changes as CH
from fintally.operators import bills as BL
from tests.helpers import ledger


def test_dedupe_hot_key_keeps_first_and_counts(spark):
    d = dt.date(2024, 1, 5)
    rows = [("f1", i, d, Decimal("-4.50"), "COFFEE", f"copy {i}") for i in range(3000)]  # one hot key
    rows += [("f2", 1, d, Decimal("-9.99"), "BOOKS", "x"), ("f2", 2, dt.date(2024, 1, 6), Decimal("-1.00"), "OLD", "y")]
    batch = spark.createDataFrame(rows, "file string, line long, date date, amount decimal(18,2), merchant string, "
                                        "description string").repartition(8)
    existing = spark.createDataFrame([(dt.date(2024, 1, 6), Decimal("-1.00"), "OLD")],
                                     "date date, amount decimal(18,2), merchant string")
    new, dups = CH.ledger_dedupe(existing, batch)
    got = {r["merchant"]: r for r in new.collect()}
    assert set(got) == {"COFFEE", "BOOKS"}
    assert got["COFFEE"]["line"] == 0 and got["COFFEE"]["copies_in_batch"] == 3000
    reasons = {r["dup_reason"]: r["count"] for r in dups.groupBy("dup_reason").count().collect()}
    assert reasons == {"in_batch": 2999, "existing": 1}


def test_apply_changes_last_write_wins_and_delete(spark):
    base = spark.createDataFrame([(1, 3, "a"), (2, 4, "b"), (3, 5, "c")], "id long, category_id long, description string")
    ch = spark.createDataFrame([(1, "category_id", "7", 1), (1, "category_id", "8", 2), (2, "description", "z", 1),
                                (3, "__delete__", None, 1), (2, "merchant", "ignored", 5)],
                               "id long, field string, value string, seq long")
    out = {r["id"]: (r["category_id"], r["description"])
           for r in CH.apply_changes(base, ch, "id", ["category_id", "description"]).collect()}
    assert out == {1: (8, "a"), 2: (4, "z")}


def test_split_validate_tolerance(spark):
    txns = spark.createDataFrame([(1, Decimal("-100.00")), (2, Decimal("-50.00"))], "id long, amount decimal(18,2)")
    splits = spark.createDataFrame([(11, 1, 3, Decimal("60.00")), (12, 1, 4, Decimal("40.01")),
                                    (21, 2, 3, Decimal("30.00")), (22, 2, 4, Decimal("19.00")),
                                    (31, 9, 3, Decimal("1.00"))],
                                   "id long, transaction_id long, category_id long, amount decimal(18,2)")
    v = {r["transaction_id"]: (r["valid"], r["parent_exists"]) for r in CH.split_validate(txns, splits).collect()}
    assert v == {1: (True, True), 2: (False, True), 9: (False, False)}


def test_dedupe_key_matches_python_text(spark):
    import hashlib
    df = spark.createDataFrame([(dt.date(2024, 1, 15), Decimal("-45.90"), "NETFLIX"),
                                (dt.date(2024, 1, 16), Decimal("12345678.50"), "ACME")],
                               "date date, amount decimal(18,2), merchant string")
    got = [r[0] for r in df.select(CH.dedupe_key()).collect()]
    want = [hashlib.sha256(f"{d}|{a}|{m}".encode()).hexdigest()
            for d, a, m in [("2024-01-15", -45.9, "NETFLIX"), ("2024-01-16", 12345678.5, "ACME")]]
    assert got == want


def test_null_changes_count_as_unchanged_and_bad_values_are_reported(spark):
    base = spark.createDataFrame([(1, "old", 5), (2, "old", 6)], "id long, name string, n long")
    feed = spark.createDataFrame([(1, "name", "new", 1), (1, "name", None, 2), (2, "n", "7", 1), (1, "n", "seven", 1), (2, "color", "red", 1)],
                                 "id long, field string, value string, seq long")
    got = {r["id"]: (r["name"], r["n"]) for r in CH.apply_changes(base, feed, "id", ["name", "n"]).collect()}
    assert got == {1: ("new", 5), 2: ("old", 7)}
    bad = {(r["id"], r["field"], r["value"], r["error"]) for r in CH.rejected_changes(base, feed, "id", ["name", "n"]).collect()}
    assert bad == {(1, "n", "seven", "value"), (2, "color", "red", "field")}


def test_repeated_ids_do_not_multiply_rows(spark):
    txns = ledger(spark, [(1, "2024-01-01", -5, "A"), (2, "2024-01-02", -6, "B")])
    cats = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    out, report = CH.bulk_categorize(txns, spark.createDataFrame([(1, 1), (1, 2), (9, 1)], "id long, category_id long"), cats)
    assert {r["id"]: r["category_id"] for r in out.collect()} == {1: 2, 2: None} and out.count() == 2 and report.count() == 2
    groups = spark.createDataFrame([(1, 10), (1, 11)], "id long, group_id long")
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    flagged = CH.mark_flags(txns, groups, ids)
    assert flagged.count() == 2 and flagged.filter("is_anomaly and is_recurring and recurring_group_id = 11").count() == 1
    bills = spark.createDataFrame([(1, "monthly", dt.date(2024, 1, 1), dt.date(2024, 2, 1))], "id long, frequency string, start_date date, next_due_date date")
    change = spark.createDataFrame([(1, "weekly", None, 1), (1, "yearly", None, 2)], "id long, frequency string, start_date date, seq long")
    assert [r["frequency"] for r in BL.bill_reschedule(bills, change, dt.date(2024, 3, 1)).collect()] == ["yearly"]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "Food"), (2, "food "), (3, " "), (4, None), (5, "Rent")], "id long, name string")
    assert {r["id"]: r["errors"] for r in CH.validate_unique_names(df).collect()} == {
        1: ["duplicate_name"], 2: ["duplicate_name"], 3: ["missing_name"], 4: ["missing_name"], 5: []}


def test_rules_and_accounts_are_validated(spark):
    cats = spark.createDataFrame([(1, "a")], "id long, name string")
    rules = spark.createDataFrame([(1, "amount_range", "1, 2.5", 1), (2, "amount_range", "1;2", 1), (3, "amount_range", None, 1), (4, "regex", "x", 9), (5, None, "x", None), (6, "merchant_exact", "a,b,c", 1), (7, "amount_range", "x,2", 1)],
                                  "id long, rule_type string, pattern string, category_id long")
    got = {r["id"]: r["errors"] for r in CH.validate_rules(rules, cats).collect()}
    assert got == {1: [], 2: ["invalid_range"], 3: ["invalid_range"], 4: ["invalid_rule_type", "unknown_category"], 5: ["invalid_rule_type", "unknown_category"], 6: [], 7: ["invalid_range"]}
    accounts = spark.createDataFrame([(1, "savings", "x"), (2, "wallet", " "), (3, None, None)], "id long, account_type string, name string")
    assert {r["id"]: r["errors"] for r in CH.validate_accounts(accounts).collect()} == {1: [], 2: ["invalid_account_type", "blank_name"], 3: ["invalid_account_type", "blank_name"]}
