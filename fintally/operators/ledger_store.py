"""The ledger on shared storage in folders by month and batch, with a rollup that follows its changes.

* ``append_batch`` writes a batch's rows to its own folders; run again, it replaces them.
* ``change_ledger`` applies a change feed to the folders that hold a changed row and to no others: the folders are
  found by their ids (one column), rewritten, and all other files stay as they are, so a feed that is run again, or
  names rows without changing them, rewrites nothing.
* ``rollup`` (month, category_id, income, expenses, rows) is the sum of one part for every batch and every change
  feed. A feed's part is its changed rows as they are, less as they were, so no unchanged row is read for it. The
  part is written once, before the folders: a feed that is run again after a failure finds it and goes on.

The driver holds a name for each folder that a feed touches, never rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.functions import money as M
from fintally.operators.changes import apply_changes
from fintally.session import written

_SUMS = ["income", "expenses", "rows"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _month():
    return F.date_format("date", "yyyy-MM")


def _replace(rows: DataFrame, path: str) -> None:
    """Replaces the folders that ``rows`` has; a large month is dealt to several tasks."""
    rows.hint("rebalance", "month", "batch").write.partitionBy("month", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/ledger")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("month", "category_id").agg(F.sum(M.income()).alias("income"), F.sum(M.expense_abs()).alias("expenses"), F.count(F.lit(1)).alias("rows"))


def _write_part(part: DataFrame, path: str, name: str) -> None:
    types = {"income": "decimal(38,2)", "expenses": "decimal(38,2)", "rows": "long"}  # the same in all parts
    part.select("month", "category_id", *[F.col(c).cast(t).alias(c) for c, t in types.items()]).write.mode("overwrite").parquet(f"{path}/rollup/part={name}")


def append_batch(txns: DataFrame, path: str, batch: str) -> None:
    """Stores ``txns`` as the rows of ``batch``; a batch that is run again with the same rows replaces its own
    (to be done before a feed changes them)."""
    rows = written(txns.withColumn("month", _month()).withColumn("batch", F.lit(batch)), "batch")
    _write_part(_sums(rows), path, f"batch-{batch}")
    _replace(rows, path)


def stored_folders(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with month and batch. (A folder that lost all its rows holds one without an id.)"""
    df = spark.read.option("mergeSchema", "false").parquet(f"{path}/ledger").where("id IS NOT NULL")
    return df.withColumn("month", F.col("month").cast("string")).withColumn("batch", F.col("batch").cast("string"))


def stored_ledger(spark: SparkSession, path: str) -> DataFrame:
    return stored_folders(spark, path).drop("month", "batch")


def _folder():
    return F.concat_ws("/", "month", "batch")


def change_ledger(spark: SparkSession, path: str, changes: DataFrame, allowed: list[str], name: str) -> list[str]:
    """Applies the feed ``changes`` (id, field, value, seq; see ``apply_changes``) under the given name and returns the
    folders rewritten. A row whose date changes moves to its month. Run again, it ends in the same rows."""
    feed = written(changes.where(F.col("id").isNotNull()), "feed")
    ids = feed.select("id").distinct()
    stored = stored_folders(spark, path)
    names = lambda df: {r[0] for r in df.select(_folder()).distinct().collect()}  # noqa: E731  a name a folder
    held = names(stored.select("id", "month", "batch").join(ids, "id", "left_semi"))
    if not held:
        return []
    columns = stored.columns
    before = written(stored.where(_folder().isin(sorted(held))).join(ids, "id", "left_semi").select(*columns), "rows-before")
    after = written(apply_changes(before, feed, "id", allowed).withColumn("month", _month()).select(*columns), "rows-after")
    if not _exists(spark, f"{path}/rollup/part=feed-{name}/_SUCCESS"):
        less = _sums(before).select("month", "category_id", *[(-F.col(c)).alias(c) for c in _SUMS])
        part = _sums(after).unionByName(less).groupBy("month", "category_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
        _write_part(part.where(" OR ".join(f"{c} <> 0" for c in _SUMS)), path, f"feed-{name}")
    # folders whose rows stay as they are need no rewriting: a feed that is run again finds none
    folders = sorted(names(before.exceptAll(after)) | names(after.exceptAll(before)))
    if not folders:
        return []
    kept = stored.where(_folder().isin(folders)).join(ids, "id", "left_anti").select(*columns)
    types = {f.name: f.dataType for f in stored.schema}
    markers = spark.createDataFrame([(f,) for f in folders], "folder string").select(*[
        (F.element_at(F.split("folder", "/"), 1 if c == "month" else 2) if c in ("month", "batch") else F.lit(None)).cast(types[c]).alias(c) for c in columns])
    _replace(written(kept.unionByName(after.where(_folder().isin(folders))).unionByName(markers), "folders"), path)
    return folders


def rollup(spark: SparkSession, path: str) -> DataFrame:
    """(month, category_id, income, expenses, rows) of the ledger as it stands; months and categories without rows
    have none."""
    parts = spark.read.parquet(f"{path}/rollup").groupBy("month", "category_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return parts.where("rows > 0").select(F.col("month").cast("string").alias("month"), "category_id", *_SUMS)


def rollup_monthly_totals(kept: DataFrame) -> DataFrame:
    """``monthly_totals`` from the rollup: month, income, expenses."""
    return kept.groupBy("month").agg(M.out(F.sum("income")).alias("income"), M.out(F.sum("expenses")).alias("expenses"))
