"""Structured Streaming variants of the incremental ledger jobs.

The batch operators stay the source of truth; each stream here is tested for equality with
its batch twin. State lives in the checkpoint location the caller passes (a shared folder
on a cluster), so a lost executor or a restarted query resumes without double counting.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fintally.functions import money as M
from fintally.operators.changes import dedupe_key
from fintally.operators.rules import rules_match
from fintally.session import written


def read_transactions_stream(spark: SparkSession, path: str, schema: T.StructType,
                             fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream of normalised transactions (new files in ``path`` are new rows)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _is_table(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to ``path`` (errors of the file system are raised)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


#: Folders of a dedupe history, by a hash of the key.
HISTORY_BUCKETS = 256


def _history(spark: SparkSession, path: str, fields: list[T.StructField]) -> DataFrame:
    # the schema is given, so a history without parts yet reads as empty
    return spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])).parquet(path)


def known_keys(spark: SparkSession, history_path: str, fields: list[T.StructField], buckets: list[int], batch_id: int) -> DataFrame:
    """The keys of some buckets that other micro-batches have stored; reads these buckets alone."""
    stored = _history(spark, history_path, fields).filter(F.col("bucket").isin(buckets) & (F.col("batch") != batch_id))
    return stored.select("dedupe_key").distinct()


def stream_ingest_dedupe(stream: DataFrame, history_path: str, keys=("date", "amount", "merchant")):
    """De-duplicate a transaction stream against itself and the full history table.

    Returns ``(keyed_stream, writer)`` where ``writer(batch_df, batch_id)`` is the ``foreachBatch``
    function: it keeps one row per dedupe key of the micro-batch (the smallest), drops keys that
    the history holds, and writes the rest as the history's part ``batch_id``. The history lies in folders by
    a hash of the key, and a micro-batch reads only those of its own keys. No row is too old: there
    is no watermark and no state beside the history. A micro-batch that is run again replaces its
    own part and is compared with the other parts alone, so it ends in the same rows.
    """
    keyed = stream.withColumn("dedupe_key", dedupe_key(*keys))

    def writer(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        rest = [c for c in batch_df.columns if c != "dedupe_key"]
        new = (batch_df.groupBy("dedupe_key").agg(F.min(F.struct(*rest)).alias("_row"))
               .select(*[F.col(f"_row.{c}").alias(c) for c in rest], "dedupe_key",
                       F.pmod(F.xxhash64("dedupe_key"), F.lit(HISTORY_BUCKETS)).cast("int").alias("bucket")))
        new = written(new, "micro-batch")
        if _is_table(spark, history_path):
            buckets = [r[0] for r in new.select("bucket").distinct().collect()]  # at most HISTORY_BUCKETS numbers
            fields = [batch_df.schema[c] for c in (*rest, "dedupe_key")]
            new = new.join(known_keys(spark, history_path, fields, buckets, batch_id), "dedupe_key", "left_anti")
        _write_parts(new.withColumn("batch", F.lit(batch_id).cast("long")), history_path)

    return keyed, writer


def _write_parts(rows: DataFrame, history_path: str) -> None:
    (rows.hint("rebalance", "bucket").write.partitionBy("bucket", "batch").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(history_path))


def compact_history(spark: SparkSession, history_path: str, upto: int) -> None:
    """Puts the parts of all micro-batches up to ``upto`` together as that one's part, a file or some a bucket. To be run
    between micro-batches, with an ``upto`` before the last one, which may still be run again. Rows are kept one
    a key, so a compaction that failed half-way can be run again."""
    fields = [f for f in spark.read.parquet(history_path).schema if f.name not in ("bucket", "batch")]
    old = _history(spark, history_path, fields).filter(F.col("batch") <= upto)
    rest = [f.name for f in fields if f.name != "dedupe_key"]
    one = old.groupBy("dedupe_key", "bucket").agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rest], "dedupe_key", "bucket")
    _write_parts(written(one, "compacted").withColumn("batch", F.lit(upto).cast("long")), history_path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(history_path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{history_path}/bucket=*/batch=*")):
        if int(status.getPath().getName().partition("=")[2]) < upto:
            fs.delete(status.getPath(), True)


def stream_rules(stream: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Stream-static categorisation: the rule table is compiled once into a projection."""
    return rules_match(stream, rules, categories)


def stream_daily_spending(stream: DataFrame) -> DataFrame:
    """|expense| per calendar day (update mode): the days that a micro-batch changes, with their new
    totals. State is one row per day, so no row is too late and nothing is held back."""
    return (stream.filter(F.col("amount") < 0).groupBy("date")
            .agg(F.sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("n"))
            .select("date", M.out("total").alias("total"), "n"))


def stream_running_balance(stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """Running balance per account (update mode): the streamed sum of amounts after the
    account's balance date, joined to the static account dimension."""
    acc = accounts.select(F.col("id").alias("account_id"), "account_type", "initial_balance",
                          "balance_as_of_date")
    s = stream.join(acc, "account_id")
    s = s.filter(F.col("balance_as_of_date").isNull() | (F.col("date") > F.col("balance_as_of_date")))
    agg = s.groupBy("account_id", "account_type", "initial_balance").agg(F.sum("amount").alias("txn_sum"))
    bal = F.when(F.col("account_type") == "credit", F.col("initial_balance") - F.col("txn_sum")) \
        .otherwise(F.col("initial_balance") + F.col("txn_sum"))
    return agg.select("account_id", M.out(bal).alias("balance"))


GOAL_STATE_SCHEMA = T.StructType([
    T.StructField("goal_id", T.LongType()),
    T.StructField("current_amount", T.DoubleType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("completing_contribution_id", T.LongType()),
])


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

#: Groups of goals, by a hash of the goal; a group is one key of the stateful operator.
GOAL_GROUPS = 1024
#: Contributions in a stored block of a group, at most.
GOAL_BLOCK = 4096
#: Blocks of a group that a worker keeps at hand in a micro-batch, at most.
GOAL_AT_HAND = 64
#: Contributions that a task of a micro-batch packs at a time, and those in one of its packs, at most.
PACKED_AT_ONCE, GOAL_PACK = 1 << 18, 256
#: Stands for null among whole numbers.
_NULL = np.iinfo(np.int64).min


def _stored(value, width: int) -> np.ndarray:
    return np.frombuffer(value[0], np.int64).reshape(-1, width) if value is not None else np.empty((0, width), np.int64)


def _block_of_rows(firsts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The block of each row: the last one whose first contribution is not behind it in (goal, time, id) order, else the first."""
    both = np.concatenate([firsts, rows[:, :3]])
    order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))  # stable: a block's first stands before rows equal to it
    block = np.empty(len(both), np.int64)
    block[order] = np.cumsum(order < len(firsts)) - 1
    return np.maximum(block[len(firsts):], 0)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _last_targets(rows: np.ndarray) -> np.ndarray:
    """(goal, target) of each goal in order, as its last row has it."""
    back = rows[::-1]
    goals, at = np.unique(back[:, 0], return_index=True)
    return np.column_stack([goals, back[at, -1]])


def _segments(number: int, block: np.ndarray) -> np.ndarray:
    """A block's rows of the index, one for each of its goals: block number, goal, first time and id, count, sum, highest running sum."""
    at = _starts(block[:, 0])
    n, run = np.diff(np.append(at, len(block))), np.cumsum(block[:, 3])
    run = run - np.repeat(run[at] - block[at, 3], n)
    return np.column_stack([np.full(len(at), number), block[at, :3], n, run[at + n - 1], np.maximum.reduceat(run, at)])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, rows) of rows that begin with their group: the other columns as whole numbers, row after row, so many rows at
    once that what follows takes a row a group, not one a contribution."""
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = _starts(rows[:, 0])
        n = np.diff(np.append(at, len(rows)))
        at = np.concatenate([np.arange(a, a + k, GOAL_PACK) for a, k in zip(at, n)])
        width = 8 * (rows.shape[1] - 1)
        ends = (np.append(at, len(rows)) * width).astype(np.int32)
        data = pa.py_buffer(np.ascontiguousarray(rows[:, 1:]))
        return pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), data])], ["group", "rows"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([c.fill_null(_NULL).to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
        if n >= PACKED_AT_ONCE:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


class GoalProcessor(StatefulProcessor):
    """State of a group of goals: their contributions in (goal, time, id) order, in blocks of at most ``GOAL_BLOCK``, and an
    index with a row for each goal of a block, see ``_segments``.

    A micro-batch reads and writes the index once and the blocks it has contributions for; every access to the state is a
    call out of the Python worker, so their number is what counts: many goals of few contributions share a block, a goal of
    many has blocks of its own. Which block first reaches the target follows from the index; only that block is read to name the
    contribution that does. So a late contribution moves the answer as it should, and what a batch reads beside its own
    blocks is seven numbers for a goal of a block.

    Rows are packs of (goal, time, id, cents, target), see ``_packs``, or, of one goal that is the key itself, columns of these names."""

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "block int", "rows binary")
        self.index = handle.getValueState("index", "blocks binary")

    def handleInputRows(self, key, rows, timerValues):
        index, at_hand, asked = _stored(self.index.get(), 7), {}, []
        for pdf in rows:
            if "rows" in pdf:
                new = np.concatenate([np.frombuffer(v, np.int64).reshape(-1, 5) for v in pdf["rows"]])
            else:
                goal, target = np.full(len(pdf), key[0]), pdf["target"].astype("Int64").fillna(_NULL)
                new = np.column_stack([goal, pdf[["time", "id", "cents"]].to_numpy(np.int64), target.to_numpy(np.int64)])
            asked.append(_last_targets(new))
            index = self._merged(index, new[:, :4], at_hand)
        self.index.update((index.tobytes(),))
        goals, cents, at, by = self._reached(index, _last_targets(np.concatenate(asked)), at_hand)
        yield pd.DataFrame({"goal_id": pd.arrays.IntegerArray(goals, np.full(len(goals), key[0] < 0)), "cents": cents, "at": at, "by": by})

    def _block(self, number: int, at_hand: dict[int, np.ndarray]) -> np.ndarray:
        return at_hand[number] if number in at_hand else _stored(self.rows.getValue((number,)), 3)

    def _merged(self, index: np.ndarray, new: np.ndarray, at_hand: dict[int, np.ndarray]) -> np.ndarray:
        """Puts contributions into their blocks; the new index."""
        starts = _starts(index[:, 0])
        ends = np.append(starts[1:], len(index))
        place = _block_of_rows(index[starts, 1:4], new)
        order = np.argsort(place, kind="stable")
        free = int(index[:, 0].max()) + 1 if len(index) else 0
        parts, done = [], 0
        for of in np.split(order, _starts(place[order])[1:]):
            block, i = new[of], int(place[of[0]])
            if len(index):
                had = index[starts[i]:ends[i]]
                kept = self._block(int(had[0, 0]), at_hand)
                block = np.concatenate([np.column_stack([np.repeat(had[:, 1], had[:, 4]), kept]), block])
                parts.append(index[done:starts[i]])
                done = ends[i]
            block = block[np.lexsort((block[:, 2], block[:, 1], block[:, 0]))]
            # a block that grew too large is cut into halves of the most, the first of which keeps its number
            pieces = [block] if len(block) <= GOAL_BLOCK else np.split(block, range(GOAL_BLOCK // 2, len(block), GOAL_BLOCK // 2))
            for k, piece in enumerate(pieces):
                number = int(index[starts[i], 0]) if k == 0 and len(index) else free
                free += number == free
                kept = np.ascontiguousarray(piece[:, 1:])
                self.rows.updateValue((number,), (kept.tobytes(),))
                if number in at_hand or len(at_hand) < GOAL_AT_HAND:
                    at_hand[number] = kept
                parts.append(_segments(number, piece))
        return np.concatenate([*parts, index[done:]])

    def _reached(self, index: np.ndarray, asked: np.ndarray, at_hand: dict[int, np.ndarray]):
        """Goals, their sums, and the time and id of the contribution that first reaches the target, or null."""
        goals, targets = asked.T
        offset, blocks = np.cumsum(index[:, 4]) - index[:, 4], _starts(index[:, 0])
        offset = offset - np.repeat(offset[blocks], np.diff(np.append(blocks, len(index))))
        mine = np.isin(index[:, 1], goals)
        index, offset = index[mine], offset[mine]
        first = _starts(index[:, 1])
        n = np.diff(np.append(first, len(index)))
        before = np.cumsum(index[:, 5]) - index[:, 5]
        before = before - np.repeat(before[first], n)
        target = np.repeat(targets, n)
        reached = np.flatnonzero((target != _NULL) & (before + index[:, 6] >= target))
        found = np.searchsorted(goals, index[reached, 1])
        found, k = np.unique(found, return_index=True)
        at, by, number = np.zeros(len(goals), np.int64), np.zeros(len(goals), np.int64), None
        for g, j in zip(found.tolist(), reached[k].tolist()):
            if number != index[j, 0]:
                number = int(index[j, 0])
                block = self._block(number, at_hand)
            there = block[offset[j]:offset[j] + index[j, 4]]
            at[g], by[g] = there[np.argmax(before[j] + np.cumsum(there[:, 2]) >= targets[g]), :2]
        none = np.isin(np.arange(len(goals)), found, invert=True)
        return goals, np.add.reduceat(index[:, 5], first), pd.arrays.IntegerArray(at, none), pd.arrays.IntegerArray(by, none)

    def close(self) -> None:
        pass


def stream_goal_state(stream: DataFrame, goals: DataFrame, state_path: str):
    """Keep the state of every goal up to date from a stream of contributions in any order of time.

    Returns ``(state_stream, writer)``. The stream (update mode) is kept by a stateful operator, see
    ``GoalProcessor``; no stored contributions are read again. ``writer`` is for ``foreachBatch``:
    ``state_path`` gets a part per micro-batch; a goal's state is the one of its latest batch (``goal_states``). A
    micro-batch that is run again replaces its own part.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cents = lambda c: (F.col(c) * 100).cast("long")
    rows = (stream.select("goal_id", "id", F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, created_at)").alias("time"), cents("amount").alias("cents"))
            .join(goals.select(F.col("id").alias("goal_id"), cents("target_amount").alias("target")), "goal_id", "left"))
    group = F.when(F.col("goal_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("goal_id"), F.lit(GOAL_GROUPS))).cast("long")
    packs = rows.select(group.alias("group"), F.col("goal_id").cast("long"), "time", F.col("id").cast("long"), "cents", "target").mapInArrow(_packs, "group long, rows binary")
    kept = packs.groupBy("group").transformWithStateInPandas(
        statefulProcessor=GoalProcessor(), outputStructType="goal_id long, cents long, at long, by long", outputMode="Update", timeMode="None")
    states = kept.select("goal_id", (F.col("cents") / 100).alias("current_amount"), F.expr(f"timestampadd(MICROSECOND, at, {_EPOCH})").alias("completed_at"),
                         F.col("by").alias("completing_contribution_id"))

    def writer(batch_df: DataFrame, batch_id: int) -> None:
        (batch_df.withColumn("batch", F.lit(batch_id).cast("long")).write.partitionBy("batch").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(state_path))

    return states, writer


def goal_states(spark: SparkSession, state_path: str) -> DataFrame:
    """The latest state of every goal that the stream has seen."""
    schema = T.StructType([*GOAL_STATE_SCHEMA.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(state_path)
    return (rows.groupBy("goal_id").agg(F.max_by(F.struct("current_amount", "completed_at", "completing_contribution_id"), "batch").alias("s"))
            .select("goal_id", "s.*"))
