"""The stored ledger: batches, changes of some folders, the rollup that follows; deep pages."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fintally.operators import analytics as A
from fintally.operators import changes as CH
from fintally.operators import ledger_store as LS
from fintally.operators import select as S
from fintally.plans import views as V
from tests.conftest import SF_SMALL
from tests.helpers import ledger

ALLOWED = ["category_id", "account_id", "description", "date", "amount"]


def _files(path):
    out = {}
    for folder, _, names in os.walk(os.path.join(path, "ledger")):
        if any(n.endswith(".parquet") for n in names):
            out["/".join(p.split("=")[1] for p in folder.split("/")[-2:])] = sorted(n for n in names if n.endswith(".parquet"))
    return out


def _plain(df):
    return sorted((tuple(r[c] for c in ("id", "date", "amount", "merchant", "description", "category_id")) for r in df.collect()), key=str)


def _recomputed(df):
    rows = LS._sums(df.withColumn("month", LS._month())).collect()
    return sorted(((r["month"], r["category_id"], r["income"], r["expenses"], r["rows"]) for r in rows), key=str)


@pytest.fixture
def store(spark, tmpdir_path):
    rng = random.Random(1)
    rows = [(i, f"2024-{rng.randrange(1, 9):02d}-{rng.randrange(1, 28):02d}", rng.randrange(-900, 900) / 10 or 1, f"M{i % 7}", rng.choice([1, 2, None])) for i in range(300)]
    led = ledger(spark, rows + [(9000, "2031-01-05", 1, "alone", 1)])
    path = os.path.join(tmpdir_path, "store")
    for b in range(3):
        for _ in range(1 + (b == 2)):  # the last batch is run again
            LS.append_batch(led.filter(F.col("id") % 3 == b), path, f"b{b}")
    return path, led


def _feed(spark, rows):
    return spark.createDataFrame([(i, f, v, s) for s, (i, f, v) in enumerate(rows)], "id long, field string, value string, seq long")


def test_batches_and_rollup(spark, store):
    path, led = store
    assert _plain(LS.stored_ledger(spark, path)) == _plain(led)
    kept = LS.rollup(spark, path)
    assert sorted(map(tuple, kept.collect()), key=str) == _recomputed(led)
    want = sorted(map(tuple, A.monthly_totals(led, dt.date(2024, 12, 31), 24).collect()))
    assert sorted(map(tuple, LS.rollup_monthly_totals(kept).select(*A.monthly_totals(led, dt.date(2024, 12, 31)).columns).collect())) == want


def test_changes_rewrite_their_folders_and_the_rollup_follows(spark, store):
    path, led = store
    before = _files(path)
    feed = _feed(spark, [(3, "category_id", "2"), (4, "__delete__", "x"), (9000, "__delete__", "x"), (5, "date", "2024-11-30"), (6, "amount", "-77.70"), (6, "amount", "-78.70"),
                         (7, "amount", "much"), (8, "merchant", "no such field"), (777777, "amount", "1.00"), (None, "amount", "1.00"), (9, "category_id", None), (3, "description", "new")])
    want = CH.apply_changes(led, feed, "id", ALLOWED)
    touched = LS.change_ledger(spark, path, feed, ALLOWED, "f0")
    after = _files(path)
    assert {f for f in before if before[f] != after.get(f)} <= set(touched) and len(touched) <= 9 < len(before)
    assert _plain(LS.stored_ledger(spark, path)) == _plain(want)
    assert sorted(map(tuple, LS.rollup(spark, path).collect()), key=str) == _recomputed(want)
    LS.change_ledger(spark, path, feed, ALLOWED, "f0")  # run again
    assert _plain(LS.stored_ledger(spark, path)) == _plain(want)
    assert sorted(map(tuple, LS.rollup(spark, path).collect()), key=str) == _recomputed(want)
    second = _feed(spark, [(5, "date", "2024-01-01"), (3, "__delete__", "x")])
    want = CH.apply_changes(want, second, "id", ALLOWED)
    LS.change_ledger(spark, path, second, ALLOWED, "f1")
    assert _plain(LS.stored_ledger(spark, path)) == _plain(want)
    assert sorted(map(tuple, LS.rollup(spark, path).collect()), key=str) == _recomputed(want)
    assert LS.change_ledger(spark, path, _feed(spark, [(123456, "amount", "1.00")]), ALLOWED, "f2") == []


def test_a_feed_that_changes_nothing_rewrites_no_folder(spark, store):
    path, led = store
    feed = _feed(spark, [(3, "category_id", "2"), (4, "__delete__", "x"), (5, "date", "2024-11-30"), (6, "amount", "-78.70")])
    assert LS.change_ledger(spark, path, feed, ALLOWED, "f0")
    files = _files(path)
    for name, rows in (("f0", feed), ("f1", _feed(spark, [(3, "category_id", "2"), (7, "amount", "much")]))):
        assert LS.change_ledger(spark, path, rows, ALLOWED, name) == [] and _files(path) == files
    want = CH.apply_changes(led, feed, "id", ALLOWED)
    assert _plain(LS.stored_ledger(spark, path)) == _plain(want)
    assert sorted(map(tuple, LS.rollup(spark, path).collect()), key=str) == _recomputed(want)


def test_a_feed_that_failed_behind_its_rollup_goes_on(spark, store, monkeypatch):
    path, led = store
    feed = _feed(spark, [(i, "category_id", "1") for i in range(0, 300, 50)])
    replace = LS._replace
    monkeypatch.setattr(LS, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        LS.change_ledger(spark, path, feed, ALLOWED, "f0")
    monkeypatch.setattr(LS, "_replace", replace)
    LS.change_ledger(spark, path, feed, ALLOWED, "f0")
    want = CH.apply_changes(led, feed, "id", ALLOWED)
    assert _plain(LS.stored_ledger(spark, path)) == _plain(want)
    assert sorted(map(tuple, LS.rollup(spark, path).collect()), key=str) == _recomputed(want)


def test_deep_pages_equal_a_full_sort(spark, monkeypatch):
    led = V.ledger(spark, SF_SMALL)
    # one date holds half of all rows; some have none
    led = led.withColumn("date", F.when(F.col("id") % 2 == 0, F.lit(dt.date(1996, 5, 5))).when(F.col("id") % 101 == 1, F.lit(None).cast("date")).otherwise(F.col("date"))).cache()
    cats = V.categories(spark)
    monkeypatch.setattr(S, "PAGE_BLOCK", 256)
    for desc in (True, False):
        order = [F.col("date").desc() if desc else F.col("date").asc(), F.col("id").asc()]
        ids = [r["id"] for r in led.orderBy(*order).select("id").collect()]
        for offset in (0, 1, 300, len(ids) // 2, len(ids) - 3, len(ids), 10 ** 6):
            assert [r["id"] for r in S.txn_page(led, cats, offset, 40, desc).collect()] == ids[offset:offset + 40], (desc, offset)
    sorted_rows, rest, dates = S._located(led, F.col("date"), True, 700, 40)
    assert len(dates) <= 3 and sorted_rows.count() < len(ids)
