"""Streaming variants agree with their batch twins."""
import datetime as dt
import os
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fintally.operators import accounts as AC
from fintally.operators import analytics as A
from fintally.operators import goals as GO
from fintally.plans import views as V
from fintally.streaming import ledger_streams as S
from tests.conftest import SF_SMALL


def _write_parts(df, path, n=4):
    df.repartition(n).write.mode("overwrite").parquet(path)


def _run(q):
    q.processAllAvailable()
    q.stop()


def test_daily_spending_stream_equals_batch(spark, tmpdir_path):
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "merchant", "description", "account_id")
    src = os.path.join(tmpdir_path, "src")
    _write_parts(led, src)
    stream = S.read_transactions_stream(spark, src, led.schema)
    q = (S.stream_daily_spending(stream).writeStream.outputMode("complete").format("memory")
         .queryName("daily_stream").option("checkpointLocation", os.path.join(tmpdir_path, "ck1")).start())
    _run(q)
    got = {r["date"]: r["total"] for r in spark.sql("select * from daily_stream").collect()}
    assert got == {r["date"]: r["total"] for r in A.daily_spending(led, V.AS_OF, 10000).collect()}


def test_running_balance_stream_equals_batch(spark, tmpdir_path):
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "account_id")
    src = os.path.join(tmpdir_path, "src")
    _write_parts(led, src)
    acc = V.accounts(spark, SF_SMALL)
    stream = S.read_transactions_stream(spark, src, led.schema, max_files_per_trigger=1)
    q = (S.stream_running_balance(stream, acc).writeStream.outputMode("update").format("memory")
         .queryName("bal_stream").option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).start())
    _run(q)
    latest = spark.sql("select account_id, last(balance) as balance from bal_stream group by account_id")
    got = {r["account_id"]: r["balance"] for r in latest.collect()}
    batch = AC.account_balance_asof(acc, led, None).collect()
    for r in batch:
        if r["id"] in got:
            assert abs(got[r["id"]] - r["balance"]) < 1e-6


def test_goal_state_stream_equals_batch(spark, tmpdir_path):
    contrib = V.contributions(spark, SF_SMALL)
    goals = V.goals(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "src")
    # small files in no order of time: an earlier contribution may come in a later micro-batch
    contrib.repartition(6, "id").write.mode("overwrite").parquet(src)
    states = os.path.join(tmpdir_path, "states")
    stream = spark.readStream.schema(contrib.schema).option("maxFilesPerTrigger", 1).parquet(src)
    s, writer = S.stream_goal_state(stream, goals, states)
    q = s.writeStream.outputMode("update").foreachBatch(writer).option("checkpointLocation", os.path.join(tmpdir_path, "ck3")).start()
    _run(q)
    got = {r["goal_id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in S.goal_states(spark, states).collect()}
    batch = {r["id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in GO.goal_state(goals, contrib).collect() if r["id"] in got}
    assert got == batch and sum(by is not None for *_, by in got.values()) > 0


def test_goal_stream_takes_late_contributions(spark, tmpdir_path):
    """Files in reverse order of time, withdrawals, one time for several ids, a goal that is not known."""
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    files = [[(9, 1, "50.00", at(9))], [(5, 1, "60.00", at(5)), (6, 1, "-30.00", at(5)), (7, 2, "10.00", at(5))], [(3, 1, "45.00", at(3, 1)), (4, 1, "45.00", at(3, 1)), (8, 7, "1.00", at(1))], [(1, 1, "-500.00", at(1)), (2, 2, "90.00", at(9))]]
    schema = "id long, goal_id long, amount decimal(18,2), created_at timestamp_ntz"
    rows = [[(i, g, Decimal(a), t) for i, g, a, t in f] for f in files]
    goals = spark.createDataFrame([(1, "trip", Decimal("100.00")), (2, "bike", Decimal("100.00"))], "id long, name string, target_amount decimal(18,2)")
    src, states = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "states")
    for n in range(len(rows)):
        spark.createDataFrame(rows[n], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        s, writer = S.stream_goal_state(stream, goals, states)
        q = s.writeStream.outputMode("update").foreachBatch(writer).option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = spark.createDataFrame([r for f in rows[:n + 1] for r in f], schema)
        want = {r["id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in GO.goal_state(goals, seen).collect()}
        got = {r["goal_id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in S.goal_states(spark, states).collect()}
        assert {g: v for g, v in got.items() if g != 7} == {g: want[g] for g in got if g != 7}
    assert got[7] == (1.0, None, None) and got[2][2] == 2


def test_ingest_dedupe_stream(spark, tmpdir_path):
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "merchant", "description")
    src = os.path.join(tmpdir_path, "src")
    # every row twice, in files of no order: old rows after new ones are kept too
    _write_parts(led.unionByName(led), src)
    hist = os.path.join(tmpdir_path, "history")
    stream = S.read_transactions_stream(spark, src, led.schema, max_files_per_trigger=1)
    keyed, writer = S.stream_ingest_dedupe(stream, hist)
    q = keyed.writeStream.foreachBatch(writer).option("checkpointLocation", os.path.join(tmpdir_path, "ck4")).start()
    _run(q)
    h = spark.read.parquet(hist)
    rows = h.count()
    assert rows == led.select("date", "amount", "merchant").distinct().count()
    assert h.groupBy("dedupe_key").count().filter(F.col("count") > 1).count() == 0
    # a micro-batch that is run again replaces its own rows
    writer(led.withColumn("dedupe_key", F.lit("k")).limit(3).drop("batch"), 99)
    writer(led.withColumn("dedupe_key", F.lit("k")).limit(3).drop("batch"), 99)
    assert spark.read.parquet(hist).count() == rows + 1


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmpdir_path):
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "merchant", "description")
    hist = os.path.join(tmpdir_path, "history")
    keyed, writer = S.stream_ingest_dedupe(led, hist)
    writer(keyed, 0)
    rows = spark.read.parquet(hist).count()
    one = keyed.orderBy("id").limit(1)
    writer(one, 1)  # an old statement is found
    assert spark.read.parquet(hist).count() == rows
    bucket = one.select(F.pmod(F.xxhash64("dedupe_key"), F.lit(S.HISTORY_BUCKETS))).first()[0]
    scan = S.known_keys(spark, hist, [keyed.schema[c] for c in keyed.columns], [bucket], 1)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {bucket})" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_compaction_keeps_rows_and_leaves_one_part(spark, tmpdir_path):
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "merchant", "description").filter("id < 400")
    hist = os.path.join(tmpdir_path, "history")
    keyed, writer = S.stream_ingest_dedupe(led, hist)
    for b in range(4):
        writer(keyed.filter(F.col("id") % 4 <= b), b)
    before = sorted(map(tuple, spark.read.parquet(hist).select(keyed.columns).collect()))
    for _ in range(2):
        S.compact_history(spark, hist, 2)
        assert sorted(map(tuple, spark.read.parquet(hist).select(keyed.columns).collect())) == before
    assert {r[0] for r in spark.read.parquet(hist).select("batch").distinct().collect()} <= {2, 3}
    writer(keyed, 4)
    assert spark.read.parquet(hist).count() == len(before)


def test_unreadable_history_fails_the_batch(spark, tmpdir_path):
    hist = os.path.join(tmpdir_path, "history", "bucket=0", "batch=0")
    os.makedirs(hist)
    with open(os.path.join(hist, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    led = V.ledger(spark, SF_SMALL).select("id", "date", "amount", "merchant", "description").withColumn("dedupe_key", F.col("id").cast("string"))
    _, writer = S.stream_ingest_dedupe(led.drop("dedupe_key"), os.path.dirname(os.path.dirname(hist)))
    with pytest.raises(Exception):
        writer(led, 1)


class _State:
    """A goal's state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.values, self.maps = 0, {}, {}

    def getValueState(self, name, schema):
        state = self

        class Value:
            def get(self):
                state.calls += 1
                return state.values.get(name)

            def update(self, value):
                state.calls += 1
                state.values[name] = value
        return Value()

    def getMapState(self, name, key, value):
        state = self

        class Map:
            def getValue(self, key):
                state.calls += 1
                return state.maps.get((name, key))

            def updateValue(self, key, value):
                state.calls += 1
                state.maps[(name, key)] = value

            def iterator(self):
                state.calls += 1
                return iter([(k, v) for (n, k), v in state.maps.items() if n == name])
        return Map()


def test_goal_processor_calls_the_state_by_block_not_by_day(monkeypatch):
    """A batch over 400 days takes some calls to the state; blocks that grow are cut, in any order of arrival."""
    monkeypatch.setattr(S, "GOAL_BLOCK", 64, raising=False)
    rng = np.random.default_rng(7)
    rows = np.stack([rng.integers(0, 300, 3000) * 86_400_000_000, rng.permutation(3000), rng.integers(-400, 500, 3000)], axis=1)
    state, processor, target = _State(), S.GoalProcessor(), 40_000
    processor.init(state)
    for n in range(0, 3000, 500):
        chunks = [pd.DataFrame(rows[n + k:n + k + 250], columns=["time", "id", "cents"]).assign(target=target) for k in (0, 250)]
        out = next(iter(processor.handleInputRows((1,), iter(chunks), None))).iloc[0]
        seen = rows[:n + 500][np.lexsort((rows[:n + 500, 1], rows[:n + 500, 0]))]
        run = np.cumsum(seen[:, 2])
        first = np.flatnonzero(run >= target)
        assert out["cents"] == run[-1]
        assert (pd.isna(out["by"]) and not len(first)) or (out["at"], out["by"]) == tuple(seen[first[0], :2])
    assert len(first)
    stored = [np.frombuffer(v[0], np.int64).reshape(-1, 3) for v in state.maps.values()]
    assert max(map(len, stored)) <= 64 and sum(map(len, stored)) == 3000
    monkeypatch.setattr(S, "GOAL_BLOCK", 4096)
    days = _State()
    processor.init(days)
    next(iter(processor.handleInputRows((1,), iter([pd.DataFrame({"time": np.arange(400) * 86_400_000_000, "id": range(400), "cents": 1, "target": 10})]), None)))
    assert days.calls <= 4


def test_goals_share_blocks_so_calls_do_not_grow_with_goals(monkeypatch):
    """Packs of many goals, in any order of arrival: the answers of each goal by itself, and some calls for all of them."""
    rng = np.random.default_rng(11)
    n, goals = 4000, 300
    goal = np.where(rng.random(n) < 0.3, 5, rng.integers(0, goals, n))
    rows = np.stack([goal, rng.integers(0, 50, n) * 86_400_000_000, rng.permutation(n), rng.integers(-300, 500, n)], axis=1)
    targets = rng.integers(0, 3000, goals)

    def packs(some):
        columns = [pa.array(np.zeros(len(some), np.int64)), *[pa.array(some[:, i]) for i in range(4)], pa.array([None if g % 7 == 0 else int(targets[g]) for g in some[:, 0]], pa.int64())]
        cut = [pa.RecordBatch.from_arrays([c[i:i + 90] for c in columns], list("abcdef")) for i in range(0, len(some), 90)]
        return [b.to_pandas() for b in S._packs(iter(cut))]

    def run(processor, some):
        out = next(iter(processor.handleInputRows((0,), iter(packs(some)), None)))
        return {r.goal_id: (r.cents, None if pd.isna(r.at) else r.at, None if pd.isna(r.by) else r.by) for r in out.itertuples()}

    def expected(seen, g):
        mine = seen[seen[:, 0] == g]
        mine = mine[np.lexsort((mine[:, 2], mine[:, 1]))]
        total = np.cumsum(mine[:, 3])
        first = np.flatnonzero(total >= targets[g]) if g % 7 else []
        return (total[-1], *(mine[first[0], 1:3] if len(first) else (None, None)))

    for block, packed in ((64, 100), (4096, 1 << 18)):
        monkeypatch.setattr(S, "GOAL_BLOCK", block)
        monkeypatch.setattr(S, "PACKED_AT_ONCE", packed)
        monkeypatch.setattr(S, "GOAL_AT_HAND", 3)
        state, processor = _State(), S.GoalProcessor()
        processor.init(state)
        for at in range(0, n, 1000):
            got = run(processor, rows[at:at + 1000])
            assert got == {g: expected(rows[:at + 1000], g) for g in np.unique(rows[at:at + 1000, 0]).tolist()}
        stored = [np.frombuffer(v[0], np.int64).reshape(-1, 3) for v in state.maps.values()]
        assert max(map(len, stored)) <= block and sum(map(len, stored)) == n
    assert state.calls <= 4 * 6  # of 300 goals in four micro-batches


def test_contributions_of_no_goal_change_no_other(spark, tmpdir_path):
    schema = "id long, goal_id long, amount decimal(18,2), created_at timestamp_ntz"
    rows = [(i, None if i % 3 == 0 else i % 5, Decimal(100 * (i % 4 + 1)), dt.datetime(2024, 1, 1 + i % 28)) for i in range(200)]
    contrib = spark.createDataFrame(rows, schema)
    goals = spark.createDataFrame([(g, Decimal(3000)) for g in range(5)], "id long, target_amount decimal(18,2)").withColumn("name", F.lit("goal"))
    src, states = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "states")
    contrib.repartition(2, "id").write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    s, writer = S.stream_goal_state(stream, goals, states)
    s.writeStream.outputMode("update").foreachBatch(writer).option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r["goal_id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in S.goal_states(spark, states).collect()}
    want = {r["id"]: (r["current_amount"], r["completed_at"], r["completing_contribution_id"]) for r in GO.goal_state(goals, contrib.where("goal_id IS NOT NULL")).collect()}
    assert got.pop(None) == (sum(float(a) for _, g, a, _ in rows if g is None), None, None)
    assert got == want and all(by is not None for *_, by in want.values())
