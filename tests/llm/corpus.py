"""Small documents that hold the awkward cases, with columns whose names the operators use inside."""
import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("mark", T.StringType()),
                       T.StructField("score", T.DoubleType()), T.StructField("word", T.StringType()), T.StructField("matches", T.LongType()), T.StructField("fp", T.LongType())])


def frame(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, f"m{n}", None, None, n, None) for n, (i, t) in enumerate(rows)], SCHEMA)


def words(rng, n, of=400):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(of)}" for _ in range(n))


def awkward():
    rng = random.Random(5)
    long = ". ".join(words(rng, 30).capitalize() for _ in range(150))
    base = [words(rng, 60) + "." for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, ""), (23, " \n\t "), (24, long), (25, long + " tail"), (26, base[3]), (27, base[3]), (27, base[3]),
             (28, base[4]), (28, base[5]), (None, base[6]), (None, "only here"), (30, "áé ñ ÄÖ 日本語 ▁ x"), (31, "the " * 300), (32, "x" * 900), (33, "A"), (34, "a")]
    return rows
