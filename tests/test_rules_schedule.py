"""Rule matching and schedule arithmetic."""
import datetime as dt

from pyspark.sql import functions as F

from fintally.functions.schedule import next_due_date
from fintally.operators import rules as RU
from fintally.plans import views as V
from tests.conftest import SF_SMALL


RULE_SCHEMA = ("id long, name string, rule_type string, pattern string, category_id long, priority long, "
               "is_active boolean, created_at timestamp")


def test_blocks_do_not_change_the_answer(spark, monkeypatch):
    led = V.ledger(spark, SF_SMALL)
    one = {r["id"]: (r["rule_category_id"], r["rule_id"])
           for r in RU.rules_match(led, V.rules(spark), V.categories(spark)).collect()}
    monkeypatch.setattr(RU, "RULE_BLOCK", 2)
    many = {r["id"]: (r["rule_category_id"], r["rule_id"])
            for r in RU.rules_match(led, V.rules(spark), V.categories(spark)).collect()}
    assert one == many and any(v[0] for v in one.values())


def test_many_rules_long_ids_and_empty_patterns(spark):
    big = 8412345678901234567
    txns = spark.createDataFrame([(1, "Corner Shop", None, -4.5, big), (2, None, "x", -1.0, None), (3, "shop 700", "y", 2.0, big)],
                                 "id long, merchant string, description string, amount double, recurring_group_id long")
    cats = spark.createDataFrame([(n, f"c{n}") for n in range(1, 900)], "id long, name string")
    when = dt.datetime(2024, 1, 1)
    rules = [(big - n, f"r{n}", "merchant_contains", f"shop {n}", n, 5, True, when) for n in range(100, 800)]
    for empty in ("merchant_contains", "description_contains"):
        all_rules = rules + [(7, "any", empty, "", 1, 1, True, when)]
        got = {r["id"]: (r["rule_category_id"], r["rule_id"], r["recurring_group_id"])
               for r in RU.rules_match(txns, spark.createDataFrame(all_rules, RULE_SCHEMA), cats).collect()}
        # an empty pattern is in every text; a missing merchant is no text, a missing description is empty
        assert got == {1: (1, 7, big), 2: (1, 7, None) if empty == "description_contains" else (None, None, None), 3: (700, big - 700, big)}


def test_rule_kinds(spark):
    txns = spark.createDataFrame(
        [(1, "STARBUCKS #12", "coffee", -4.5), (2, "Netflix", None, -15.99), (3, "X", "rent", -1500.0)],
        "id long, merchant string, description string, amount double")
    rules = spark.createDataFrame(
        [(1, "r1", "merchant_contains", "starbucks", 3, 1, True, dt.datetime(2024, 1, 1)),
         (2, "r2", "merchant_exact", "NETFLIX", 11, 1, True, dt.datetime(2024, 1, 2)),
         (3, "r3", "amount_range", "1000,2000", 1, 0, True, dt.datetime(2024, 1, 3)),
         (4, "r4", "amount_range", "oops", 2, 9, True, dt.datetime(2024, 1, 4))],
        "id long, name string, rule_type string, pattern string, category_id long, priority long, "
        "is_active boolean, created_at timestamp")
    cats = spark.createDataFrame([(1, "Housing"), (2, "T"), (3, "Food"), (11, "Subs")], "id long, name string")
    got = {r["id"]: r["rule_category_id"] for r in RU.rules_match(txns, rules, cats).collect()}
    assert got == {1: 3, 2: 11, 3: 1}


def test_next_due_month_end_sticks(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), "monthly"), (dt.date(2024, 1, 10), "weekly"),
                                (dt.date(2024, 5, 1), "yearly"), (dt.date(2023, 11, 30), "quarterly"),
                                (dt.date(2024, 1, 31), "bogus")], "start date, freq string")
    got = [r[0] for r in df.select(next_due_date(F.col("start"), F.col("freq"), dt.date(2024, 3, 15))).collect()]
    # 01-31 -> 02-29 -> 03-29 (the clamped day sticks); weekly steps from 01-10; future start
    # stays; quarterly 11-30 -> 02-29 -> 05-29; unknown frequency steps monthly
    assert got == [dt.date(2024, 3, 29), dt.date(2024, 3, 20), dt.date(2024, 5, 1),
                   dt.date(2024, 5, 29), dt.date(2024, 3, 29)]


def test_stabbing_equals_a_sweep_over_all_ranges():
    import random

    import numpy as np
    rng = random.Random(4)
    for n in (0, 1, 5, 60, 3000):
        ranges = []
        for rank in rng.sample(range(10 * n + 1), n):
            lo = rng.choice([rng.randrange(0, 40), rng.random() * 40, float("-inf")])
            ranges.append((rank, lo, rng.choice([lo, lo + rng.randrange(0, 9), lo - 1, float("inf"), float("nan"), rng.random() * 40])))
        amounts = np.array([x for r in ranges for x in r[1:]] + [rng.random() * 45 for _ in range(300)] + [0.0, 40.0, float("nan")])
        want = np.full(len(amounts), 10 * n + 5)
        for rank, lo, hi in sorted(ranges, reverse=True):
            want[(lo <= amounts) & (amounts <= hi)] = rank
        assert (RU.Stabbing(ranges, 10 * n + 5).ranks(amounts) == want).all()


def test_a_hundred_thousand_range_rules_cost_one_search_an_amount():
    import time

    import numpy as np
    rules = [(i, "amount_range", f"{i % 1000},{i % 1000 + i % 7}.5", i) for i in range(100_000)]
    block = RU.RuleBlock(rules)
    amounts = np.linspace(0, 1010, 200_000)
    began = time.time()
    ranks = block.ranges.ranks(amounts)
    assert time.time() - began < 5 and ranks[0] == 0 and ranks[-1] == len(rules)


def test_many_blocks_pass_one_python_step_and_hold_one_matcher(spark, monkeypatch):
    monkeypatch.setattr(RU, "RULE_BLOCK", 3)
    monkeypatch.setattr(RU, "HELD_ROWS", 7)
    when = dt.datetime(2024, 1, 1)
    txns = spark.createDataFrame([(i, f"Shop {i % 20}" if i % 6 else None, [None, "note x", ""][i % 3], float(i) if i % 5 else None) for i in range(60)],
                                 "id long, merchant string, description string, amount double").coalesce(1)
    kinds = [("merchant_contains", "shop 1"), ("merchant_exact", "SHOP 7"), ("description_contains", "x"), ("amount_range", "40,41"), ("merchant_contains", "p 3")]
    rules = [(i, f"r{i}", *kinds[i % 5], i % 4 + 1, i % 7, True, when) for i in range(40)]
    cats = spark.createDataFrame([(i, f"c{i}") for i in range(1, 5)], "id long, name string")
    got = RU.rules_match(txns, spark.createDataFrame(rules, RULE_SCHEMA), cats)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

    def holds(kind, pattern, m, d, a):
        if kind == "amount_range":
            return a is not None and 40 <= abs(a) <= 41
        return pattern.lower() in (d or "").lower() if kind == "description_contains" else m is not None and (
            m.lower() == pattern.lower() if kind == "merchant_exact" else pattern.lower() in m.lower())
    order = sorted(rules, key=lambda r: (-r[5], r[0]))
    want = {i: next(((r[4], r[0]) for r in order if holds(r[2], r[3], m, d, a)), (None, None)) for i, m, d, a in (tuple(t) for t in txns.collect())}
    assert {r["id"]: (r["rule_category_id"], r["rule_id"]) for r in got.collect()} == want
    # of rules alike in kind and pattern the first alone is asked
    assert sum(map(len, RU._blocks(spark.createDataFrame(rules, RULE_SCHEMA), cats))) == 5
