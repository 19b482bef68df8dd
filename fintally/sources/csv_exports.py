"""Bank CSV exports: many files with preambles and differing headers, read as one DataFrame.

Files are read line by line (splittable), so a large export is spread over tasks. A line's
position in its file is (split start offset, increasing id inside the split); only the
first split of each file is searched for the header line, among its first 20 lines.
A quote opens a field only at the field's start, closes it unless another quote follows, and is a plain
character elsewhere. Whether a line starts inside a quoted field depends on all lines before it, so lines
are read as functions: each line takes the state at its start (record start or in quotes) to the state at its
end. Functions are composed inside every split, then over the splits of a file (one row a split), so each
split learns the state it starts in without any task reading the file in order. Files in which no line
opens a field that it does not close skip that step. Fields are split by one linear regular expression
(JVM-side, no Python) and paired with their file's header as a ``map<string,string>``. No file can fail the
others: missing fields are NULL, surplus ones are left out, blank and repeated header names are numbered, and
a field that never closes, or that would be over a million characters long, is read line by line.

Excel files must be converted to CSV upstream.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fintally.formats import HEADER_WORDS
from fintally.session import written

HEADER_SCAN_LINES = 20

# a field behind its comma: quoted (with doubled quotes inside, and what follows the closing quote; one that
# doesn't close goes on to the end), or all up to the next comma
_FIELD_RE = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_OPEN_FIELD_RE = r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+|\z)|[^,]*+)'
_UNCLOSED_RE = r'^"[^"]*+(?:""[^"]*+)*+\z'
_QUOTED_RE = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Tasks that list the folders of exports, for each core.
LISTS_A_CORE = 4

#: Characters of a record of several lines, at most.
MAX_RECORD = 1_000_000


def _csv_fields(record):
    """Fields of one record: split on commas outside quotes, unquote, un-double; what stands behind a
    closing quote belongs to the field."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD_RE), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(_QUOTED_RE), F.concat(
        F.replace(F.regexp_extract(p, _QUOTED_RE, 1), F.lit('""'), F.lit('"')), F.regexp_extract(p, _QUOTED_RE, 2))).otherwise(p))


def leaves_open(line):
    """Whether a line read from a record's start ends inside a quoted field."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_OPEN_FIELD_RE), F.lit(1))
    return F.element_at(parts, -1).rlike(_UNCLOSED_RE)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, blk, pos, line) for every line; (blk, pos) orders the lines of a file."""
    # folders are listed at once here, by a task each up to this number: the tasks cost more than listing small folders
    number = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(number), LISTS_A_CORE * spark.sparkContext.defaultParallelism)))
    try:
        df = spark.read.option("lineSep", "\n").text(path)
    finally:
        spark.conf.set(LISTING_TASKS, number)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("blk"),
                     F.monotonically_increasing_id().alias("pos"),
                     F.regexp_replace("value", "\r$", "").alias("line"))


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """``read_lines``, written as a table: the steps behind it read the lines several times, and opening many small files
    costs far more than their bytes. Every export is opened once."""
    return written(read_lines(spark, path), "lines")


def line_functions(lines: DataFrame) -> DataFrame:
    """``lines`` with from_start and from_quotes: whether the line ends in quotes if it starts at a record's
    start, and if it starts in quotes (as it would behind an opening quote)."""
    quoted = F.contains("line", F.lit('"'))
    return lines.withColumn("from_start", quoted & leaves_open(F.col("line"))).withColumn(
        "from_quotes", ~quoted | leaves_open(F.concat(F.lit('"'), F.col("line"))))


def line_states(lines: DataFrame) -> DataFrame:
    """``lines`` with in_quotes (the state each line starts in) and ends_open (of its file).

    Of the four functions on two states, constants reset the state and the swap turns it around: the state
    behind a line is the last constant's, or the split's first state, turned as often as swaps follow. Running
    sums of swaps give that without a loop: a constant is noted relative to the sum where it stands."""
    own = Window.partitionBy("file", "blk").orderBy("pos")
    upto, splits = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file").orderBy("blk")
    f = line_functions(lines)
    f = f.withColumn("w", F.sum((F.col("from_start") & ~F.col("from_quotes")).cast("int")).over(upto))
    fixed = F.when(F.col("from_start") == F.col("from_quotes"), (F.col("from_start").cast("int") + F.col("w")) % 2)
    f = f.withColumn("c", F.last(fixed, ignorenulls=True).over(upto))
    # one row a split: its function, composed over the splits before it in the same way
    ends = f.groupBy("file", "blk").agg(F.max_by(F.struct("w", "c"), "pos").alias("f")).select("file", "blk", "f.*")
    ends = ends.withColumn("sum", F.sum("w").over(splits))
    ends = ends.withColumn("last", F.last((F.col("c") + F.col("w") + F.col("sum")) % 2, ignorenulls=True).over(splits.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("after", (F.coalesce("last", F.lit(0)) + F.col("sum")) % 2)
    ends = ends.select("file", "blk", F.coalesce(F.lag("after").over(splits), F.lit(0)).alias("first"),
                       (F.last("after").over(splits.rowsBetween(0, Window.unboundedFollowing)) == 1).alias("ends_open"))
    before = (F.coalesce(F.lag("c").over(own), F.col("first")) + F.coalesce(F.lag("w").over(own), F.lit(0))) % 2
    return f.join(ends, ["file", "blk"]).withColumn("in_quotes", before == 1).select(*lines.columns, "in_quotes", "ends_open")


def records(lines: DataFrame) -> DataFrame:
    """(file, blk, pos, line): lines with the further lines of their quoted fields joined by a line break."""
    # a file's lines all start a record unless one of them leaves a field open
    broken = line_functions(lines).groupBy("file").agg(F.max("from_start").alias("any")).where("any").select("file")
    simple = lines.join(broken, "file", "left_anti")
    starts = line_states(lines.join(broken, "file", "left_semi")).withColumn("start", (~F.col("in_quotes")).cast("long"))
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = starts.groupBy("file", "blk").agg(F.sum("start").alias("s")).withColumn("r0", F.coalesce(F.sum("s").over(before), F.lit(0)))
    totals = totals.withColumn("n", F.sum("s").over(Window.partitionBy("file"))).drop("s")
    numbered = starts.join(totals, ["file", "blk"]).withColumn("rec", F.col("r0") + F.sum("start").over(own))
    # the last record of a file that ends in quotes has a quote that never closes
    lost = (F.col("ends_open") & (F.col("rec") == F.col("n"))).alias("lost")
    # written, as it is read three times and stands behind all the steps above
    numbered = written(numbered.select("file", "blk", "pos", "line", "rec", lost), "numbered")
    lost = F.col("lost")
    large = numbered.groupBy("file", "rec").agg(F.sum(F.length("line") + 1).alias("size")).where(F.col("size") > MAX_RECORD).select("file", "rec")
    single = numbered.where(lost).unionByName(numbered.where(~lost).join(large, ["file", "rec"], "left_semi"), allowMissingColumns=True)
    joined = (numbered.where(~lost).join(large, ["file", "rec"], "left_anti").groupBy("file", "rec")
              .agg(F.sort_array(F.collect_list(F.struct("blk", "pos", "line"))).alias("l"))
              .select("file", F.col("l")[0]["blk"].alias("blk"), F.col("l")[0]["pos"].alias("pos"),
                      F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("line")))
    return simple.select("file", "blk", "pos", "line").unionByName(single.select("file", "blk", "pos", "line")).unionByName(joined)


def header_lines(lines: DataFrame, scan: int = HEADER_SCAN_LINES) -> DataFrame:
    """Per file: the header line (the first of the first ``scan`` lines that has a comma and a
    header word; the first non-blank line when none does) and its position."""
    w = Window.partitionBy("file").orderBy("pos")
    head = lines.filter(F.col("blk") == 0).withColumn("n", F.row_number().over(w))
    low = F.lower(F.trim("line"))
    is_header = (F.col("n") <= scan) & F.contains(low, F.lit(",")) & F.exists(
        F.array(*[F.lit(x) for x in HEADER_WORDS]), lambda wd: F.contains(low, wd))
    place = F.when(is_header, F.struct(F.lit(0).alias("k"), F.col("n"))).when(F.length(low) > 0, F.struct(F.lit(1).alias("k"), F.col("n")))
    return (head.withColumn("place", place).filter(F.col("place").isNotNull()).groupBy("file")
            .agg(F.min("n").alias("hn"), F.min_by("pos", "place").alias("hpos"), F.min_by("line", "place").alias("hline")))


def header_names(header):
    """Trimmed names; a blank one is 'Unnamed: <position>', the k-th repeat of a name gets '.<k>'."""
    named = F.transform(header, lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(F.trim(x)))

    def once(names):
        def numbered(x, i):
            k = F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
            return F.when(k == 0, x).otherwise(F.concat(x, F.lit("."), k.cast("string")))
        return F.transform(names, numbered)

    def distinct(names):  # a name may already look like a numbered one
        return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(
            F.transform(names, lambda x, i: F.concat(x, F.lit("."), i.cast("string"))))
    return F.transform(F.array(named), lambda names: distinct(once(names)))[0]


def _headers(lines: DataFrame) -> DataFrame:
    return header_lines(lines).select(
        "file", "hpos", header_names(_csv_fields(F.col("hline"))).alias("header"))


def src_csv_headers(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """(file, position, column) of every export's header, from the header search alone. ``lines``: the exports'
    ``stored_lines``, if they are there already."""
    heads = _headers(read_lines(spark, path) if lines is None else lines)
    return heads.select("file", F.posexplode("header").alias("position", "column"))


def src_csv_exports(spark: SparkSession, path: str, clean: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """One row per record of every export under ``path``:
    (file, blk, pos, header array, values array, row map<string,string>).

    Values are padded with NULL to the header; blank records are dropped, and with ``clean`` those whose
    values are all empty (``src_clean_rows``). ``lines``: the exports' ``stored_lines``, if they are there already.
    """
    lines = stored_lines(spark, path) if lines is None else lines
    # the search for the header reads lines; a line break inside a header name is not looked for
    data = (records(lines).join(_headers(lines), "file")
            .filter((F.col("blk") > 0) | (F.col("pos") > F.col("hpos")))
            .filter(F.length(F.trim("line")) > 0))
    fields = _csv_fields(F.col("line"))
    values = F.transform(F.array(fields), lambda v: F.transform("header", lambda _, i: F.get(v, i)))[0]
    out = data.select("file", "blk", "pos", "header", values.alias("values"))
    out = out.withColumn("row", F.map_from_arrays("header", "values"))
    return src_clean_rows(out) if clean else out


def src_clean_rows(rows: DataFrame) -> DataFrame:
    """Drop rows whose values are all null or empty."""
    return rows.filter(F.exists("values", lambda v: v.isNotNull() & (F.length(v) > 0)))


def src_sample_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` data rows of each file with nulls as '' (per-file top-n)."""
    w = Window.partitionBy("file").orderBy("blk", "pos")
    return (rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
            .select("file", F.col("_n").alias("sample_no"),
                    F.map_from_arrays("header", F.transform("values", lambda v: F.coalesce(v, F.lit(""))))
                    .alias("row")))
