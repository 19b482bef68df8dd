"""The stored gram table: searches, new batches and the folders they touch."""
import os
import random

import pytest
from pyspark.sql import functions as F

from fintally.operators import text_store as TS

WORDS = ["coffee bar", "Cafe_12", "a%b", "A_B", "back\\slash", "aXb", "x", "", "Ünïcode Straße", "東京 カフェ", "aaaa", "aa", "ab ab ab", "b" * 200]
NEEDLES = ["a", "coffee", "e_1", "_", "%", "\\", "b a", "aa", "straße", "カフェ", "zzz", "ab", "fee bar", "  bar ", "bbbb", "", None, "A%B"]
PATTERNS = ["%a_b%", "a_b", "%", "", "_", "__", "%_%_%", "%a%a%", "c%r", "%\\%", "%e b%", "_ü%", "%カ_ェ", "aa%", "%aa", "%b_a%b%", "%zz%", "%\\s%h", None, "COFFEE%"]


def _rows(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, u) for i, (t, u) in enumerate(texts)], "id long, merchant string, description string")


def _texts(n=120, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ab_% c\\") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    return [(m, rng.choice([None, *WORDS])) for m in made] + [(w, None) for w in WORDS] + [(None, "only here"), (None, None), ("coffee bar", "coffee bar")]


def _like(text, pattern):
    """LIKE, by the table of all prefixes."""
    reach = [True] + [False] * len(text)
    for p in pattern:
        if p == "%":
            reach = [any(reach[:i + 1]) for i in range(len(reach))]
        else:
            reach = [False] + [reach[i] and (p == "_" or text[i] == p) for i in range(len(text))]
    return reach[-1]


def _expected(texts, needles, wild, columns=(0, 1)):
    out = set()
    for q, needle in enumerate(needles):
        if needle is None or (not wild and not needle.strip(" ")):
            continue
        n = needle.lower() if wild else needle.strip(" ").lower()
        out |= {(q, i) for i, row in enumerate(texts) if any(row[c] is not None and (_like(row[c].lower(), n) if wild else n in row[c].lower()) for c in columns)}
    return out


def _asked(spark, needles):
    return spark.createDataFrame(list(enumerate(needles)), "query_id long, text string")


def _found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _state(path):
    return {(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


@pytest.mark.parametrize("wild", [False, True])
def test_matches_brute_force_over_two_batches(spark, tmpdir_path, wild):
    texts, needles = _texts(), PATTERNS if wild else NEEDLES
    TS.add_batch(_rows(spark, texts[:70]), ["merchant", "description"], tmpdir_path, "one")
    TS.add_batch(_rows(spark, texts[40:]), ["merchant", "description"], tmpdir_path, "two")
    got = TS.search_rows(spark, tmpdir_path, _asked(spark, needles), _rows(spark, texts), ["merchant", "description"], wild=wild)
    assert _found(got) == _expected(texts, needles, wild)
    one = TS.search_rows(spark, tmpdir_path, _asked(spark, needles), _rows(spark, texts), ["description"], wild=wild)
    assert _found(one) == _expected(texts, needles, wild, (1,))


def test_a_new_batch_touches_no_other_and_runs_again(spark, tmpdir_path):
    TS.add_batch(_rows(spark, [("alpha", None), ("beta", None)]), ["merchant"], tmpdir_path, "one")
    before = _state(tmpdir_path)
    new = _rows(spark, [("beta", None), ("gamma", None)], 2)
    for _ in range(2):
        TS.add_batch(new, ["merchant"], tmpdir_path, "two")
        assert before <= _state(tmpdir_path)
        stored = [r["s"] for r in TS._table(spark, tmpdir_path, "strings").collect()]
        assert sorted(stored) == ["alpha", "beta", "gamma"]
    TS.add_batch(_rows(spark, [("alpha", None), ("beta", None)]), ["merchant"], tmpdir_path, "one")
    assert sorted(r["s"] for r in TS._table(spark, tmpdir_path, "strings").collect()) == ["alpha", "beta", "gamma"]


def test_search_reads_the_buckets_of_its_grams_only(spark, tmpdir_path):
    rows = _rows(spark, [(f"merchant {i}", None) for i in range(300)])
    TS.add_batch(rows, ["merchant"], tmpdir_path, "one")
    probes = TS._probes(spark, tmpdir_path, spark.createDataFrame([("ant 299", False)], "pattern string, wild boolean"))
    assert probes.count() == TS.PROBES and "299" in {r["g"] for r in probes.collect()}
    plan = TS._candidates(spark, tmpdir_path, probes)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("\n")[0]
    got = TS.search_rows(spark, tmpdir_path, _asked(spark, ["ant 299"]), rows, ["merchant"])
    assert _found(got) == {(0, 299)}


def test_rows_are_met_as_they_are_now(spark, tmpdir_path):
    TS.add_batch(_rows(spark, [("tea", None), ("tea house", None)]), ["merchant"], tmpdir_path, "one")
    now = _rows(spark, [("Tea", None)], 7).withColumn("s", F.lit("clash")).withColumn("pattern", F.lit(1))
    got = TS.search_rows(spark, tmpdir_path, _asked(spark, ["tea"]), now, ["merchant"])
    assert _found(got) == {(0, 7)}


def test_empty_store_and_queries(spark, tmpdir_path):
    TS.add_batch(_rows(spark, []), ["merchant"], tmpdir_path, "none")
    assert TS.search_rows(spark, tmpdir_path, _asked(spark, ["a", "%"]), _rows(spark, []), ["merchant"], wild=True).count() == 0
    TS.add_batch(_rows(spark, [("a", None)]), ["merchant"], tmpdir_path, "some")
    assert TS.search_rows(spark, tmpdir_path, _asked(spark, []), _rows(spark, [("a", None)]), ["merchant"]).count() == 0


def test_a_long_text_is_looked_up_by_a_gram_that_few_strings_hold(spark, tmpdir_path):
    rows = _rows(spark, [(f"Customer#{i * 7919:09d}", "1-urgent") for i in range(1, 2000)])
    TS.add_batch(rows, ["merchant", "description"], tmpdir_path, "one")
    asked = spark.createDataFrame([("customer#000791900", False), ("customer%7919%", True), ("%7919_", True)], "pattern string, wild boolean")
    probes = TS._probes(spark, tmpdir_path, asked)
    freq = TS._table(spark, tmpdir_path, "freq").select("g", "n")
    least = {r["pattern"]: r["n"] for r in probes.join(freq, "g").groupBy("pattern").agg(F.min("n").alias("n")).collect()}
    assert least["customer#000791900"] == 1
    # the section that all strings hold is not looked up beside the rare one
    assert all(set(r["g"]) <= set("7919") for r in probes.where("wild").collect())
    assert TS._candidates(spark, tmpdir_path, probes.where("pattern = 'customer%7919%'")).count() < 100
    got = TS.search_rows(spark, tmpdir_path, _asked(spark, ["customer%7919%"]), rows, ["merchant", "description"], wild=True)
    assert _found(got) == {(0, i - 1) for i in range(1, 2000) if "7919" in f"{i * 7919:09d}"}


def test_a_place_without_the_characters_beside_the_gram_is_dropped_where_it_is_read(spark, tmpdir_path):
    texts = [(f"a12345{i:02d}z", None) for i in range(100)] + [(f"a{i:02d}34567z", None) for i in range(100) if i != 12]
    rows = _rows(spark, texts)
    TS.add_batch(rows, ["merchant"], tmpdir_path, "one")
    probes = TS._probes(spark, tmpdir_path, spark.createDataFrame([("%1234567_", True)], "pattern string, wild boolean"))
    # each gram alone stands in many strings, its place beside the rest of the run in one
    assert TS._candidates(spark, tmpdir_path, probes.withColumn("probes", F.lit(1).cast("long"))).count() == 1
    got = TS.search_rows(spark, tmpdir_path, _asked(spark, ["%1234567_"]), rows, ["merchant"], wild=True)
    assert _found(got) == {(0, 67)}


def test_runs_of_all_lengths(spark, tmpdir_path):
    rng = random.Random(9)
    texts = [("".join(rng.choice("aab_") for _ in range(rng.randrange(1, 45))), None) for _ in range(60)]
    rows, needles, patterns = _rows(spark, texts), [], []
    for n in [*range(1, 36)] * 2:
        text = rng.choice([t for t, _ in texts if len(t) >= n])
        at = rng.randrange(len(text) - n + 1)
        needles.append(text[at:at + n])
        run = "".join(rng.choice(["_", c, c, c, c, c, c]) for c in needles[-1])
        patterns.append(rng.choice(["", "%"]) + run[:n // 2] + rng.choice(["", "%"]) + run[n // 2:] + "%")
    TS.add_batch(rows, ["merchant"], tmpdir_path, "one")
    for asked, wild in ((needles, False), (patterns, True)):
        got = TS.search_rows(spark, tmpdir_path, _asked(spark, asked), rows, ["merchant"], wild=wild)
        assert _found(got) == _expected(texts, asked, wild, (0,))
