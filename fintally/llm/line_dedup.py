"""Lines that several documents share, kept in one document only: as keep bitmaps, not as texts.

A line's key is the line without the white space at its ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines except those
in the largest doc_id that holds them.

Every such line becomes a row of two 64-bit hashes of its key, its document and its position. Rows are
range-partitioned by the leading bits of the hash and sorted by hash, document (largest first) and
position, so that one stream over a partition meets the lines that stay before those that go. Ranges
are counted first: one with far more rows than the mean (a line that a third of all documents hold)
is split into slices of documents, each of which is streamed like a range of its own; the slices' first
documents and numbers of documents are then put together, one row a slice. What goes is returned as a
run-length coded bitmap per document; texts are moved only to apply it.

Only DataFrame functions are used. Defined cases: a null or empty text is one empty line; a null doc_id
counts as one document, smaller than all others; rows of one doc_id are one document when documents
are counted, and each loses its own lines; repeated rows get the same bitmap; an empty table gives no
rows; other columns of the input are not read, whatever their names.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fintally.llm import common

#: White space at the ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that a partition of the hash ranges is meant for, and ranges in one partition.
PARTITION_ROWS, RANGES = 2_000_000, 8


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """a, b (hashes of the key), doc, mark (of the text), pos, for every line whose key is long enough."""
    whole = common.whole_text(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), common.text_mark(f"`{text}`").alias("mark"), F.posexplode(lines_of(whole)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    key = F.translate("line", string.ascii_uppercase, string.ascii_lowercase)
    # the second hash is seeded with that of a constant
    return rows.select(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"), "doc", "mark", "pos")


def streamed(rows: DataFrame, min_docs: int) -> DataFrame:
    """The occurrences that go, as far as one range or slice can tell: columns of ``rows`` (r, slices, a, b,
    doc, mark, pos) with slice, nth (the line's document, counted from the largest) and n_docs. Of ranges in
    slices all rows are returned."""
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffles, -(-rows.count() // PARTITION_ROWS))
    bits = max(1, (n * RANGES - 1).bit_length())
    rows = rows.withColumn("r", F.shiftrightunsigned("a", 64 - bits))
    sizes = rows.groupBy("r").count()
    mean = F.greatest(F.lit(1), F.lit(rows.count() / 2 ** bits))
    # at most a quarter of the ranges hold over 4 times the mean: a row of 16 bytes for every
    # PARTITION_ROWS / RANGES rows of input at the most, and in fact few
    large = sizes.where(F.col("count") > 4 * mean).select("r", F.ceil(F.col("count") / mean).alias("slices"))
    rows = rows.join(F.broadcast(large), "r", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc"), F.col("slices")))
    order = [F.desc_nulls_last("doc"), F.asc("mark"), F.asc("pos")]
    rows = rows.repartitionByRange(n, "r", "slice").sortWithinPartitions("r", "slice", "a", "b", *order)
    group = Window.partitionBy("r", "slice", "a", "b")
    rows = rows.withColumn("nth", F.dense_rank().over(group.orderBy(F.desc_nulls_last("doc"))))
    rows = rows.withColumn("n_docs", F.max("nth").over(group))
    return rows.where((F.col("slices") > 1) | (F.col("n_docs") >= min_docs) & (F.col("nth") > 1))


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, mark, pos of every line that goes; repeated rows of ``docs`` repeat theirs."""
    rows = common.written(occurrences(docs, text, doc_id, min_chars), "lines")
    found = common.written(streamed(rows, min_docs), "line_groups")
    whole, sliced = found.where("slices = 1"), found.where("slices > 1")
    parts = sliced.groupBy("a", "b", "slice").agg(F.max("doc").alias("top"), F.max("nth").alias("n"))
    keys = parts.groupBy("a", "b").agg(F.max("top").alias("stays"), F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    verdicts = parts.select("a", "b", "slice").join(keys.drop("n"), ["a", "b"])
    gone = sliced.join(verdicts, ["a", "b", "slice"]).where(~F.col("doc").eqNullSafe(F.col("stays")))
    return whole.select("doc", "mark", "pos").unionByName(gone.select("doc", "mark", "pos"))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """doc, mark, n_dropped, runs, for every document that loses a line.

    ``runs`` is the bitmap of the lines that stay, run-length coded: lines kept, lines dropped, lines
    kept and so on, from line 0; behind the last run all lines stay."""
    rows = dropped_lines(docs, **options).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    first = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
    last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
    rows = rows.select("doc", "mark", F.size("p").cast("long").alias("n_dropped"), first.alias("first"), last.alias("last"))
    runs = F.flatten(F.transform("first", lambda x, i: F.array(x - F.coalesce(F.get("last", i - 1) + 1, F.lit(0)), F.get("last", i) - x + 1)))
    return rows.select("doc", "mark", "n_dropped", runs.alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """``text`` without the lines that the bitmap drops; a null bitmap drops none."""
    def apply(parts: Column) -> Column:
        lines, lengths = parts["lines"], parts["runs"]
        # where each run ends, as a running sum in steps of pairs
        ends = F.aggregate(lengths, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("sum")),
                           lambda s, x: F.struct(F.array_append(s["at"], s["sum"] + x).alias("at"), (s["sum"] + x).alias("sum")), lambda s: s["at"])
        return F.transform(F.array(ends), lambda at: F.array_join(F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(lengths), F.lit(2)),
            lambda i: F.slice(lines, F.coalesce(F.get(at, i - 1), F.lit(0)) + 1, F.coalesce(F.get(lengths, i), F.size(lines))))), "\n"))[0]

    return F.when(runs.isNull(), text).otherwise(F.transform(F.array(F.struct(lines_of(text).alias("lines"), runs.alias("runs"))), apply)[0])


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, runs (null if no line goes), kept (the text that stays),
    one row for each row of ``docs``."""
    maps = keep_bitmaps(docs, text=text, doc_id=doc_id, **options)
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), common.text_mark(f"`{text}`").alias("__mark"), common.whole_text(f"`{text}`").alias("whole"))
    joined = whole.join(maps, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("__mark") == F.col("mark")), "left")
    return joined.select("doc_id", F.size(lines_of(F.col("whole"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
                         "runs", kept_text(F.col("whole"), F.col("runs")).alias("kept"))
