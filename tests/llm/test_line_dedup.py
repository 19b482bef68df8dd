import random
from collections import Counter, defaultdict

import pytest
from corpus import awkward, frame, words

from fintally.llm import line_dedup as L

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    rank = lambda d: (d is not None, d or 0)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)], key=rank)]
        out[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = awkward()
    shared = [words(rng, 6) for _ in range(30)]
    for d in range(100, 400):
        lines = [rng.choice([words(rng, 3), rng.choice(shared), f"  {rng.choice(shared).upper()}\t\r", "", "short"]) for _ in range(rng.randrange(1, 9))]
        if d % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "a line that every third document holds")
        out.append((d, "\n".join(lines)))
    out += [(500, "x" * 20 + "\n" + "x" * 19), (501, "X" * 20), (502, "\n" + "x" * 20 + "\n\n"), (503, "É" * 20), (504, "é" * 20), (505, "É" * 20), (506, "É" * 20),
            (507, " " + "y" * 19), (508, " " + "y" * 19), (None, " " + "y" * 19), (None, "z" * 30), (509, "z" * 30), (510, "z" * 30),
            (511, ("w" * 25 + "\n") * 40), (512, "w" * 25), (513, "w" * 25 + "\n" + "w" * 25),
            (514, "one id, several texts\nlost"), (514, "one id, several texts\nlost too"), (515, "one id, several texts"), (516, "one id, several texts"), (514, "one id, several texts\nlost"),
            (517, "\n".join(f"long document, line {i % 700}" for i in range(9000))), (518, "\n".join(f"long document, line {i}" for i in range(900))), (519, "long document, line 3\nlong document, line 650")]
    return out


def test_lines_equal_brute_force(spark, rows):
    got = L.drop_repeated_lines(frame(spark, rows))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == brute(rows)


def test_hot_ranges_are_sliced_and_give_the_same(spark, rows):
    """A line of a third of all rows makes its range large: the slices are put together again."""
    many = rows + [(d, "one line in all of these documents\nand this shared line too") for d in range(2000, 4000)]
    found = L.streamed(L.occurrences(frame(spark, many), "text", "doc_id", 20), 3)
    sliced = found.where("slices > 1").select("a", "slice").distinct().groupBy("a").count().collect()
    assert max(r["count"] for r in sliced) > 4
    got = L.drop_repeated_lines(frame(spark, many))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == brute(many)


def test_bitmaps_are_run_lengths(spark):
    rows = [(1, "\n".join(["a shared line, number one"] * 3 + ["own", "a shared line, number two", "own too"])), (2, "a shared line, number one\na shared line, number two"),
            (3, "a shared line, number one"), (4, "x\na shared line, number two\na shared line, number one"), (5, None)]
    got = {r["doc"]: (r["n_dropped"], r["runs"]) for r in L.keep_bitmaps(frame(spark, rows)).collect()}
    assert got == {1: (4, [0, 3, 1, 1]), 2: (2, [0, 2]), 3: (1, [0, 1])}


def test_other_bounds_and_empty_table(spark):
    rows = [(1, "abc\nq"), (2, "ABC "), (3, "zz")]
    got = L.drop_repeated_lines(frame(spark, rows), min_chars=3, min_docs=2)
    assert sorted((r["doc_id"], r["kept"]) for r in got.collect()) == [(1, "q"), (2, "ABC "), (3, "zz")]
    none = L.drop_repeated_lines(frame(spark, []))
    assert none.collect() == [] and none.columns == ["doc_id", "n_lines", "n_dropped", "runs", "kept"]


def test_plan_streams_over_the_ranges(spark, rows):
    docs = frame(spark, rows)
    plan = L.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    # both windows stand on the range partitioning: nothing is shuffled or sorted again
    plan = L.streamed(L.occurrences(docs, "text", "doc_id", 20), 3)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("rangepartitioning")]
    assert above.count("Window ") >= 2 and "hashpartitioning" not in above
