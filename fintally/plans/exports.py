"""Bank-export files derived from the driver tables (for the file-source queries).

``write_exports`` turns v_raw into one CSV text file per account export, each with a
two-line preamble and a blank line before the header, occasional blank and all-empty
lines, and quoted fields where needed. ``awkward`` exports also hold short rows, quoted line breaks, single quotes
inside unquoted fields, in every third file a last field that never closes and, in every other file, repeated
and blank header names. Every file's lines go to one task and are written
in order.
"""
from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.plans import views as V
from fintally.session import local_path, scratch_dir

HEADER = "Date,Amount,Merchant,Description"
#: Last line of some awkward exports: its quote opens a field and never closes.
UNCLOSED = '1992-01-01,-1.00,Left Open,"never'

#: Tasks that write the exports, for each core: files differ in size, so some more than cores.
TASKS_A_CORE = 4


def _quote(c):
    c = F.coalesce(c, F.lit(""))
    needs = F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n"))
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def awkward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows with quoted line breaks in every 29th description, no description field in every 31st row
    and an inch mark in every 17th description."""
    k = F.col("line")
    text = F.when(k % 31 == 0, F.lit(None).cast("string")).when(
        k % 29 == 0, F.concat(F.col("raw_description"), F.lit('\nsecond, "line"'))).when(
        k % 17 == 0, F.concat(F.col("raw_description"), F.lit(' 5" pipe'))).otherwise(F.col("raw_description"))
    return V.raw_rows(spark, sf_dir).withColumn("raw_description", text)


def export_lines(spark: SparkSession, sf_dir: str, awkward: bool = False) -> DataFrame:
    r = awkward_rows(spark, sf_dir) if awkward else V.raw_rows(spark, sf_dir)
    header = F.when(F.lit(awkward) & F.col("file").rlike("[13579].csv$"), F.lit(HEADER + ",Description,")).otherwise(F.lit(HEADER))
    files = r.select("file").distinct()
    pre = files.select("file", F.explode(F.array(
        F.struct(F.lit(-4).cast("long").alias("seq"), F.concat(F.lit("Statement for "), F.col("file")).alias("text")),
        F.struct(F.lit(-3).cast("long").alias("seq"), F.lit("Account: 1234").alias("text")),
        F.struct(F.lit(-2).cast("long").alias("seq"), F.lit("").alias("text")),
        F.struct(F.lit(-1).cast("long").alias("seq"), header.alias("text")))).alias("l")) \
        .select("file", "l.seq", "l.text")
    # an inch mark stands in a field without quotes around it
    description = F.when(F.col("raw_description").endswith(' 5" pipe'), F.col("raw_description")).otherwise(_quote(F.col("raw_description")))
    data = r.select("file", "line", (F.col("line") * 2 + 1).alias("seq"),
                    F.concat_ws(",", _quote(F.col("raw_date")), _quote(F.col("raw_amount")), _quote(F.col("raw_merchant")),
                                F.when(F.lit(not awkward) | F.col("raw_description").isNotNull(), description)).alias("text"))
    # the rows are derived once for their own lines and the empty ones before some of them
    line = F.col("line")
    before = F.array_compact(F.array(F.when(line % 53 == 0, F.lit(",,,")), F.when(line % 37 == 0, F.lit(""))))
    data = data.select("file", F.explode(F.concat(F.array(F.struct("seq", "text")), F.transform(before, lambda t: F.struct((F.col("seq") - 1).alias("seq"), t.alias("text"))))).alias("l")).select("file", "l.*")
    out = pre.unionByName(data)
    if awkward:
        last = files.where(F.col("file").rlike("[0369].csv$")).select("file", F.lit(1 << 62).alias("seq"), F.lit(UNCLOSED).alias("text"))
        out = out.unionByName(last)
    return out


def write_files(lines: DataFrame, folder: str) -> None:
    """``lines`` (file, value; a file's lines in order, in one partition) as text files ``file=<file>/part-0.txt`` of a
    folder that all tasks see as a local path. Spark's own writer starts four processes a file there (``chmod``, as long
    as Hadoop's native library is missing), 20 ms of a core. A file gets its name when it is whole, so a
    task that is run again leaves the same files."""
    def write(batches):
        import os
        import uuid

        def close(f, part, name):
            f.close()
            os.replace(part, os.path.join(os.path.dirname(part), "part-0.txt"))
            return name
        now, done = None, []  # (open file, its path, the export's name)
        for batch in batches:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if now is None or now[2] != names[i]:
                    if now:
                        done.append(close(*now))
                    at = os.path.join(folder, f"file={names[i]}")
                    os.makedirs(at, exist_ok=True)
                    part = os.path.join(at, f".part-{uuid.uuid4().hex}")
                    now = open(part, "w", encoding="utf-8", newline=""), part, names[i]
                now[0].write("".join(f"{v}\n" for v in values[i:j]))
                i = j
        if now:
            done.append(close(*now))
        yield pa.record_batch([pa.array([len(done)], pa.int64())], ["files"])

    lines.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def write_exports(spark: SparkSession, sf_dir: str, awkward: bool = False) -> str:
    """Write the exports under a new scratch folder; returns the folder.

    A task writes its files one after the other, and there are many small ones: they are dealt to a fixed number of tasks,
    as the adaptive number follows the bytes alone."""
    out, tasks = scratch_dir(spark, "exports"), TASKS_A_CORE * spark.sparkContext.defaultParallelism
    lines = (export_lines(spark, sf_dir, awkward).repartition(tasks, "file").sortWithinPartitions("file", "seq")
             .select("file", F.col("text").alias("value")))
    folder = local_path(spark, out)
    if folder:
        os.makedirs(folder)
        write_files(lines, folder)
    else:
        lines.write.partitionBy("file").text(out)
    return out


def export_name(file_col="file"):
    """The export name (acct_N.csv) from a written file path."""
    return F.regexp_extract(F.col(file_col), r"file=([^/]+)/", 1)
