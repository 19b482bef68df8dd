"""End-to-end import jobs over a directory of bank exports.

``parse_exports``: read every file, map columns by name (or a caller's mapping), normalise
rows -> (good, rejected). ``analyze_exports``: per-file format, smart column mapping,
confidence, account type and totals. ``import_into_ledger``: dedupe good rows against the
ledger and report per file. ``import_job``: the whole way from files to categorised rows, their
log and vectors, and a report with row errors. Everything but the scratch tables that a job
uses several times stays lazy until the caller writes or collects.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fintally.formats import aliases_df, formats_df
from fintally.operators import changes as CH
from fintally.operators import profile as P
from fintally.operators import rules as RU
from fintally.operators import similarity as SI
from fintally.operators import vector_store as VS
from fintally.session import written
from fintally.sources.csv_exports import src_csv_exports, src_csv_headers, stored_lines

_FIELDS = ["date", "amount", "merchant", "description"]


def name_mapping(headers: DataFrame, spark: SparkSession) -> DataFrame:
    by_name = P.detect_columns_by_name(headers, aliases_df(spark))
    wide = by_name.groupBy("file").pivot("field", _FIELDS).agg(F.first("column"))
    files = headers.select("file").distinct()
    out = files.join(wide, "file", "left")
    for f in _FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, F.lit(None).cast("string"))
    return out.select("file", *[F.col(f).alias(f"{f}_column") for f in _FIELDS])


def fixed_mapping(headers: DataFrame, mapping: dict) -> DataFrame:
    files = headers.select("file").distinct()
    return files.select("file", *[F.lit(mapping.get(f)).cast("string").alias(f"{f}_column") for f in _FIELDS])


def parse_exports(spark: SparkSession, path: str, column_mapping: dict | None = None):
    """(good, rejected) normalised rows of every export under ``path``."""
    lines = stored_lines(spark, path)
    rows = src_csv_exports(spark, path, lines=lines)
    headers = src_csv_headers(spark, path, lines)
    mapping = fixed_mapping(headers, column_mapping) if column_mapping else name_mapping(headers, spark)
    return P.norm_row(rows, mapping)


def analyze_exports(spark: SparkSession, path: str) -> DataFrame:
    """Per file: format, smart mapping, confidence, account type and totals.

    The parsed rows and the small per-file / per-column frames are written to the shared scratch folder:
    the mapping steps reuse them many times, and recomputing means re-reading every export.
    """
    lines = stored_lines(spark, path)
    rows = written(src_csv_exports(spark, path, lines=lines), "export-rows")
    headers = written(src_csv_headers(spark, path, lines), "export-headers")
    fmts = formats_df(spark)
    names = headers.select("file").distinct().select(
        "file", F.element_at(F.split("file", "/"), -1).alias("file_name"))
    ff = written(P.detect_format(headers, fmts, names), "formats")
    prof = written(P.column_profiles(P.cells(rows)), "profiles")
    mapping = written(P.detect_columns(headers, prof, fmts, aliases_df(spark), ff), "mapping")
    amounts = P.file_amounts(rows, mapping)
    return (ff.join(mapping, "file")
            .join(P.detect_confidence(ff, mapping), "file")
            .join(P.detect_account_type(amounts, ff, fmts, mapping).withColumnRenamed("confidence", "type_confidence"),
                  "file")
            .join(P.profile_file_totals(amounts), "file", "left"))


def import_into_ledger(spark: SparkSession, path: str, existing: DataFrame, column_mapping: dict | None = None):
    """Returns (new_rows, duplicates, report) for an import of ``path`` into ``existing``."""
    good, rejected = parse_exports(spark, path, column_mapping)
    batch = good.withColumnRenamed("pos", "line").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    new, dups = CH.ledger_dedupe(existing, batch, order=("file", "blk", "line"))
    report = CH.import_report(batch, new, rejected)
    return new, dups, report


#: Row errors that a report lists for each file.
FIRST_ERRORS = 10


def row_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` (file, blk, pos, ...) with row, their number in the file from 1. Rows are numbered inside their split;
    the splits before it add one number each."""
    own, before = Window.partitionBy("file", "blk").orderBy("pos"), Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "blk").agg(F.count(F.lit(1)).alias("_n")).select("file", "blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    return rows.withColumn("row", F.row_number().over(own)).join(sizes, ["file", "blk"]).withColumn("row", F.col("row") + F.col("_n0")).drop("_n0")


def import_errors(rejected: DataFrame) -> DataFrame:
    """(file, skipped, total_errors, first_errors) of rejected rows with their number: rows without a date or an amount
    are skipped, others are errors; an amount that cannot be read is named before a date."""
    amount = (F.col("status") == "bad_amount") | (F.col("status") == "bad_date") & F.col("amount").isNull()
    text = F.when(amount, "Invalid amount").when(F.col("status") == "bad_date", "Invalid date format")
    rows = rejected.select("file", "row", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), text).alias("error"))
    first = (rows.filter(F.col("error").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("row")))
             .filter(F.col("n") <= FIRST_ERRORS).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "error"))), lambda x: x["error"]).alias("first_errors")))
    counts = rows.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("skipped"), F.count("error").alias("total_errors"))
    return counts.join(first, "file", "left")


@dataclass
class Import:
    """What an import job leaves: the new rows (id, file, date, amount, merchant, description, category_id, method: 'rule',
    'auto', 'needs_review' or 'no_match'), the categorisation log and vectors of the rows categorised by votes, the
    duplicates, and the report per file."""
    rows: DataFrame
    log: DataFrame
    vectors: DataFrame
    duplicates: DataFrame
    report: DataFrame


def import_job(spark: SparkSession, path: str, existing: DataFrame, rules: DataFrame, categories: DataFrame, store: str | None = None,
               dim: int = 384, loader=None, column_mapping: dict | None = None) -> Import:
    """Reads, cleans, de-duplicates and categorises every export under ``path``.

    New rows get their category from the first matching rule; the others ask the vector ``store`` (see
    ``vector_store``) for their nearest neighbours' votes, if one is given. A row's id follows from its dedupe key, so
    a job that is run again gives the same ids. Nothing is written but scratch tables: append ``rows`` and ``log``, and
    put ``vectors`` into the store by ``change_store``, under the job's batch id."""
    lines = stored_lines(spark, path)
    rows = src_csv_exports(spark, path, lines=lines)
    headers = src_csv_headers(spark, path, lines)
    mapping = fixed_mapping(headers, column_mapping) if column_mapping else name_mapping(headers, spark)
    # written, as good rows, rejected ones and the numbers of all rows come from it: the exports are parsed once
    converted = written(P.converted_rows(rows, mapping), "converted")
    good = converted.filter(F.col("status") == "ok").drop("status").withColumnRenamed("pos", "line").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    numbered = row_numbers(converted.select("file", "blk", "pos", "amount", "status"))
    errors = written(import_errors(numbered.filter(F.col("status") != "ok")), "row-errors")
    new, duplicates = CH.ledger_dedupe(existing, good, order=("file", "blk", "line"))
    new = new.withColumn("id", F.xxhash64(CH.dedupe_key("date", "amount", "merchant")))
    ruled = written(RU.rules_match(new.select("id", "file", "date", "amount", "merchant", "description"), rules, categories), "ruled")
    known = F.col("rule_category_id").isNotNull() & (F.col("rule_category_id") != 0)
    done = ruled.filter(known).withColumn("category_id", F.col("rule_category_id")).withColumn("method", F.lit("rule"))
    open_rows = ruled.filter(~known).withColumn("category_id", F.lit(None).cast("long"))
    columns = ["id", "file", "date", "amount", "merchant", "description", "category_id", "method"]
    if store is None:
        rest, log, vectors = open_rows.withColumn("method", F.lit("no_match")), None, None
    else:
        texts = open_rows.select(F.col("id").alias("query_id"), SI.embed_text("merchant", "description", "amount").alias("text"))
        queries = written(SI.embed_batch(texts, "text", dim=dim, loader=loader).select("query_id", "vector"), "queries")
        near = written(VS.search_store(spark, store, queries, SI.TOP_K_SIMILAR), "neighbours")
        votes = written(SI.auto_categorize(near, VS.stored_vectors(spark, store), categories), "votes")
        named, vectors, log = SI.auto_categorize_apply(votes, near, open_rows, categories, dim=dim, loader=loader)
        rest = named.join(votes.select(F.col("query_id").alias("id"), F.col("method").alias("_m")), "id", "left").withColumn("method", F.coalesce("_m", F.lit("no_match")))
    out = written(done.select(*columns).unionByName(rest.select(*columns)), "imported")
    by_file = out.groupBy("file").agg(F.count(F.lit(1)).alias("added"), *[F.count_if(F.col("method") == m).alias(m) for m in ("rule", "auto", "needs_review")])
    parsed = good.groupBy("file").agg(F.count(F.lit(1)).alias("parsed"))
    report = headers.select("file").distinct().join(parsed, "file", "left").join(by_file, "file", "left").join(errors, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select("file", zero("parsed"), zero("skipped"), zero("total_errors"), F.coalesce("first_errors", F.array().cast("array<string>")).alias("first_errors"),
                           zero("added"), (F.coalesce("parsed", F.lit(0)) - F.coalesce("added", F.lit(0))).cast("long").alias("duplicates"), zero("rule"), zero("auto"), zero("needs_review"))
    return Import(out, log, vectors, duplicates, report)
