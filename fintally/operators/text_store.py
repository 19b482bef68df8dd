"""Substring and wildcard search through a stored table of character grams with their places.

A store is a folder with three tables, each with a folder a batch:

* ``strings`` (h, s, len): the distinct lower-cased strings, each in the batch that first held it; strings that are
  alike in the hash h are met together and told apart by the pattern;
* ``grams`` (g, h, at, near), below that a folder a hash bucket of g: every place of every run of ``SIZES`` characters,
  with the characters beside it, so many that the next size is reached on either side;
* ``freq`` (g, n): how often the batch's new strings hold a gram.

Grams are cut when a batch is added, never by a search, and each task writes those of its own strings. A pattern is
cut at its ``%`` into sections and these at ``_`` into runs; of the section with the rarest gram the rarest grams of the
two largest sizes of a run (at most ``PROBES``) are looked up, the pattern's characters beside them must stand there too,
and they must stand at their own distance in the string. So a run shorter than the largest size is met where it stands
as a whole, and no other place leaves the task that reads it. That gives all strings that can match, and a few more; the pattern itself
then decides. Sizes go up by steps, so that a long text has a gram that few of many strings hold; a section that most
strings hold is not looked up beside a rarer one. A search reads the folders of its grams' buckets. A pattern without any character to look up asks for a
length only, and meets the strings of the lengths it allows. The driver holds bucket numbers and at most
``LISTED`` grams, never strings.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fintally.session import written

#: Folders of ``grams`` in a batch.
BUCKETS = 64
#: Characters of a gram.
SIZES = (1, 2, 3, 5, 8, 16)
#: Grams looked up for a pattern.
PROBES = 2
#: A gram that stands this many times as often as the pattern's rarest one is not looked up beside it.
COMMON = 4
#: Up to this many grams are named in the scan's filter; beyond it their buckets alone are.
LISTED = 1000
#: Up to this many grams are sent to all tasks, which pass on the places of these alone.
SENT = 500_000
#: Characters of the strings whose grams a task cuts and sorts.
SLICE = 500_000

_STRINGS = "h int, s string, len int, batch string"
_GRAMS = "g string, h int, at int, near string, batch string, bucket int"
_FREQ = "g string, n long, batch string"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema({"strings": _STRINGS, "grams": _GRAMS, "freq": _FREQ}[name]).parquet(f"{path}/{name}")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")


def _beside(n: int) -> int:
    """Characters kept on either side of a gram of n: what a run that is too short for the next size can have there."""
    return next((m - n - 1 for m in SIZES if m > n), 0)


def _placed_grams(s: Column, sizes: int = len(SIZES)) -> Column:
    """(at, g, near, back) of every run of ``SIZES`` characters, or of the largest ``sizes`` of them that s has; places
    count from 1, near is the ``back`` characters before the gram and those after it."""
    def of(n: int, above: int | None) -> Column:
        c, length = _beside(n), F.length(s)
        def gram(i: Column) -> Column:
            back = F.least(i - 1, F.lit(c))
            near = F.concat(F.substring(s, i - back, back), F.substring(s, i + n, F.lit(c))) if c else F.lit("")
            return F.struct(i.alias("at"), F.substring(s, i, F.lit(n)).alias("g"), near.alias("near"), back.alias("back"))
        places = F.sequence(F.lit(1), F.greatest(length - (n - 1), F.lit(1)))
        return F.filter(F.transform(places, gram), lambda _: (length >= n) & (length < above if above else F.lit(True)))
    return F.concat(*[of(n, SIZES[i + sizes] if i + sizes < len(SIZES) else None) for i, n in enumerate(SIZES)])


def _strings(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*[F.lower(F.col(c).cast("string")) for c in columns])).alias("s")).where("s IS NOT NULL").distinct()


def add_batch(rows: DataFrame, columns: list[str], path: str, batch: str) -> None:
    """Adds the strings of ``columns`` that no other batch of the store holds; null is no string. A batch that is run
    again replaces its own folders. The first call makes the store; batches are added one at a time."""
    spark = rows.sparkSession
    new = _strings(rows, columns).select(F.hash("s").alias("h"), "s", F.length("s").alias("len"))
    if _has(spark, f"{path}/strings"):
        held = _table(spark, path, "strings").where(F.col("batch") != batch).select("h", "s")
        new = new.join(held, ["h", "s"], "left_anti").select("h", "s", "len")
    new = written(new, "new-strings")  # read by the three writes
    slices = max(1, -(-(new.agg(F.sum("len")).first()[0] or 0) // SLICE))
    grams = new.repartition(slices).select("h", F.explode(_placed_grams(F.col("s"))).alias("x")).select("x.g", "h", "x.at", "x.near").withColumn("bucket", _bucket())
    grams.sortWithinPartitions("bucket", "g").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams/batch={batch}")
    counts = _table(spark, path, "grams").where(F.col("batch") == batch).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/freq/batch={batch}")
    new.write.mode("overwrite").parquet(f"{path}/strings/batch={batch}")


def _has(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _probes(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(pattern, wild, at, g, near, back, bucket, probes): the grams to look up, ``probes`` of them, all of one section."""
    cut = asked.select("pattern", "wild", F.posexplode(F.when(F.col("wild"), F.split("pattern", "%")).otherwise(F.array("pattern"))).alias("section", "part"))
    cut = cut.withColumn("runs", F.when(F.col("wild"), F.split("part", "_")).otherwise(F.array("part")))
    runs = cut.select("pattern", "wild", "section", "runs", F.posexplode("runs").alias("r", "run")).where("run <> ''")
    ahead = F.aggregate(F.slice("runs", 1, F.col("r")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    grams = runs.select("pattern", "wild", "section", ahead.alias("ahead"), F.explode(_placed_grams(F.col("run"), 2)).alias("x"))
    grams = grams.select("pattern", "wild", "section", (F.col("ahead") + F.col("x.at")).alias("at"), "x.g", "x.near", "x.back")
    freq = _table(spark, path, "freq").groupBy("g").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("pattern", "wild")
    order = whole.orderBy("n", F.length("g"), "section", "at")
    ranked = grams.join(freq, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("least", F.first(F.struct("section", "n")).over(order)).where("section = least.section AND n <= least.n * {}".format(COMMON))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROBES)
    return ranked.select("pattern", "wild", "at", "g", "near", "back", _bucket().alias("bucket"), F.count(F.lit(1)).over(whole).alias("probes"))


def _candidates(spark: SparkSession, path: str, probes: DataFrame) -> DataFrame:
    """(pattern, wild, h): strings that hold the grams, with the characters beside them, at their distance."""
    wanted = probes.select("g").distinct()
    grams = [r["g"] for r in wanted.limit(LISTED + 1).collect()]
    buckets = sorted(r["bucket"] for r in probes.select("bucket").distinct().collect())
    postings = _table(spark, path, "grams").where(F.col("bucket").isin(buckets))
    if len(grams) <= LISTED:
        postings = postings.where(F.col("g").isin(grams))
    elif wanted.limit(SENT + 1).count() <= SENT:
        postings = postings.join(F.broadcast(wanted), "g", "left_semi")
    kept = F.create_map(*[F.lit(x) for n in SIZES for x in (n, _beside(n))])
    places = postings.select("g", "h", F.col("at").alias("place"), F.col("near").alias("beside"), F.least(F.col("at") - 1, kept[F.length("g")]).alias("held"))
    there = F.substring("beside", F.col("held") - F.col("back") + 1, F.length("near")) == F.col("near")
    hits = places.join(probes.drop("bucket"), "g").where((F.col("held") >= F.col("back")) & there)
    found = hits.select("pattern", "wild", "h", (F.col("place") - F.col("at")).alias("start"), "probes")
    found = found.repartition("pattern", "wild", "h")  # both groupings below use this one exchange
    stands = found.groupBy("pattern", "wild", "h", "start", "probes").agg(F.count(F.lit(1)).alias("n")).where("n >= probes")
    return stands.select("pattern", "wild", "h").distinct()


def search_strings(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """(pattern, wild, s): the stored strings that each distinct pattern matches. ``patterns`` has pattern (lower case) and
    wild: false, the string holds the pattern's characters; true, the whole string is LIKE the pattern, where ``%``
    stands for any characters, ``_`` for one, and a backslash for itself. A null pattern matches nothing."""
    asked = written(patterns.select("pattern", "wild").where("pattern IS NOT NULL").distinct(), "patterns")
    probes = written(_probes(spark, path, asked), "probes")
    strings = _table(spark, path, "strings").select("h", "s", "len")
    found = strings.join(_candidates(spark, path, probes), "h")
    free = asked.join(probes.select("pattern", "wild").distinct(), ["pattern", "wild"], "left_anti")
    longest = strings.agg(F.max("len")).first()[0]
    if longest is not None:
        least = F.length(F.when(F.col("wild"), F.replace("pattern", F.lit("%"), F.lit(""))).otherwise(F.lit("")))
        most = F.when(F.col("wild") & ~F.contains("pattern", F.lit("%")), least).otherwise(F.greatest(least, F.lit(longest)))
        lengths = free.select("pattern", "wild", F.explode(F.sequence(least, most)).alias("len"))
        found = found.select("pattern", "wild", "s").unionByName(strings.join(lengths, "len").select("pattern", "wild", "s"))
    like = F.like(F.col("s"), F.replace("pattern", F.lit("\\"), F.lit("\\\\")))
    return found.where((F.col("wild") & like) | (~F.col("wild") & F.contains("s", "pattern"))).select("pattern", "wild", "s")


def search_rows(spark: SparkSession, path: str, queries: DataFrame, rows: DataFrame, columns: list[str], query_id: str = "query_id",
                text: str = "text", wild: bool = False, row_id: str = "id") -> DataFrame:
    """(query_id, id), once each, of the ``rows`` of which one of ``columns`` (all in the store), without regard to
    case, holds the query's text or, with ``wild``, is LIKE it.

    Rows are met by equality of their strings, so rows that went since the strings were stored are not found, and new rows
    with strings that the store holds are. Without ``wild`` the text is trimmed, and an empty one asks nothing."""
    needle = F.lower(F.col(text)) if wild else F.lower(F.trim(F.col(text)))
    asked = queries.select(F.col(query_id).alias("__query"), needle.alias("pattern"), F.lit(wild).alias("wild"))
    if not wild:
        asked = asked.where("pattern <> ''")
    found = search_strings(spark, path, asked).join(asked, ["pattern", "wild"]).select("__query", "s").distinct()
    held = rows.select(F.col(row_id).alias("__row"), F.explode(F.array_distinct(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]))).alias("s"))
    return held.join(found, "s").select(F.col("__query").alias(query_id), F.col("__row").alias(row_id)).distinct()
