"""Savings goals: progress, state folded from contributions, pace to the target date."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.functions.dates import as_date


def goal_progress(goals: DataFrame, contributions: DataFrame, active_only: bool = True) -> DataFrame:
    """Contribution count and sum per goal (pre-aggregated, then joined) and progress %.

    progress = current / target * 100 (0 when target <= 0); ``progress_ui`` is the UI's
    rounded value capped at 100.
    """
    g = goals.filter(F.col("is_active")) if active_only else goals
    agg = contributions.groupBy("goal_id").agg(F.count(F.lit(1)).alias("contribution_count"),
                                               F.sum("amount").alias("total_contributed"))
    cur = F.coalesce("total_contributed", M.zero())
    t = F.col("target_amount")
    prog = F.when(t > 0, cur.cast("double") / t.cast("double") * 100).otherwise(F.lit(0.0))
    return (g.join(agg, g.id == agg.goal_id, "left")
            .select("id", "name", M.out(t).alias("target_amount"),
                    F.coalesce("contribution_count", F.lit(0)).cast("long").alias("contribution_count"),
                    M.out("total_contributed").alias("total_contributed"),
                    M.out(cur).alias("current_amount"),
                    prog.alias("progress"),
                    F.when(t > 0, F.least(F.lit(100.0), F.floor(prog + 0.5).cast("double")))
                    .otherwise(F.lit(0.0)).alias("progress_ui")))


def goal_state(goals: DataFrame, contributions: DataFrame) -> DataFrame:
    """Fold contributions in (created_at, id) order: current amount and the time the running
    total first reached the target (``completed_at``; it stays set after later withdrawals).

    Skew-safe: a hot goal is cut into blocks of at most 4,096 ids of one time, these into hours. Running
    sums inside a block partition by (goal, time, id block), inside an hour by (goal, hour), so a bulk
    import that shares one time is split too; an hour's summary is one row per goal, and only the rows
    of the single crossing block are scanned again.
    """
    c = contributions.select("id", "goal_id", "amount", "created_at", F.date_trunc("hour", "created_at").alias("hour"),
                             F.struct("created_at", F.floor(F.col("id") / 4096).alias("part")).alias("blk"))
    w_in = (Window.partitionBy("goal_id", "blk").orderBy("id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = c.withColumn("run_in", F.sum("amount").over(w_in))
    small = c.groupBy("goal_id", "hour", "blk").agg(F.sum("amount").alias("b_sum"), F.max("run_in").alias("b_max"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("b_sum").over(earlier(Window.partitionBy("goal_id", "hour").orderBy("blk"))), M.zero())
    hours = small.groupBy("goal_id", "hour").agg(F.sum("b_sum").alias("h_sum"))
    hours = hours.select("goal_id", "hour", F.coalesce(F.sum("h_sum").over(earlier(Window.partitionBy("goal_id").orderBy("hour"))), M.zero()).alias("h_before"))
    blocks = (small.withColumn("within", within).join(hours, ["goal_id", "hour"])
              .withColumn("before", F.col("h_before") + F.col("within")))
    tgt = goals.select(F.col("id").alias("goal_id"), "target_amount")
    crossing = (blocks.join(tgt, "goal_id")
                .filter(F.col("before") + F.col("b_max") >= F.col("target_amount"))
                .groupBy("goal_id").agg(F.min("blk").alias("blk"),
                                        F.min_by("before", "blk").alias("before")))
    completed = (c.join(crossing, ["goal_id", "blk"]).join(tgt, "goal_id")
                 .filter(F.col("before") + F.col("run_in") >= F.col("target_amount"))
                 .groupBy("goal_id").agg(F.min(F.struct("created_at", "id")).alias("first")))
    current = contributions.groupBy(F.col("goal_id").alias("id")).agg(F.sum("amount").alias("current"))
    completed = completed.withColumnRenamed("goal_id", "id")
    return (goals.join(current, "id", "left").join(completed, "id", "left")
            .select("id", "name", M.out("target_amount").alias("target_amount"),
                    M.out(F.coalesce("current", M.zero())).alias("current_amount"),
                    F.col("first.created_at").alias("completed_at"),
                    F.col("first.id").alias("completing_contribution_id")))


def goal_pace(state: DataFrame, goals: DataFrame, as_of) -> DataFrame:
    """Days remaining to the target date and the monthly amount still needed.

    monthly_needed = 0 when done or undated; the whole remainder when the date has passed;
    else ceil(remaining / (days / 30)).
    """
    g = goals.select(F.col("id"), "target_date")
    j = state.join(g, "id")
    days = F.datediff(F.col("target_date"), as_date(as_of))
    remaining = F.col("target_amount") - F.col("current_amount")
    needed = (F.when(F.col("target_date").isNull(), F.lit(0.0))
              .when(remaining <= 0, F.lit(0.0))
              .when(days <= 0, remaining)
              .otherwise(F.ceil(remaining / (days / 30.0)).cast("double")))
    return j.select("id", "name", "target_date", days.cast("long").alias("days_remaining"),
                    needed.alias("monthly_needed"))


def contribution_history(goals: DataFrame, contributions: DataFrame, txns: DataFrame) -> DataFrame:
    """Every contribution of a known goal with the transaction it came from, if there is one."""
    t = txns.select(F.col("id").alias("transaction_id"), "merchant", F.col("date").alias("transaction_date"))
    g = goals.select(F.col("id").alias("goal_id"), F.col("name").alias("goal_name"))
    return (contributions.join(g, "goal_id").join(t, "transaction_id", "left")
            .select("id", "goal_id", "goal_name", M.out("amount").alias("amount"), "created_at", "transaction_id", "merchant", "transaction_date"))
