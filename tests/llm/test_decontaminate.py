import random

import pytest
from corpus import awkward, frame, words

from fintally.llm import decontaminate as D


def distance(pattern, text):
    """Smallest edit distance of the pattern to a substring of the text, by the plain recurrence."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcxyz")
        elif kind == 1:
            s.insert(i, rng.choice("abcxyz"))
        else:
            del s[i]
    return "".join(s)


def test_myers_matches_the_recurrence():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 120)))
        d = distance(p, t)
        best, end = D.myers(p, t, 200)
        assert best == d and distance(p, t[:end]) == d
        assert D.myers(p, t, 1)[0] == min(d, 2)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    items = [(n, words(rng, 30).capitalize() + ".") for n in range(12)] + [(None, words(rng, 25)), (50, None), (51, " ?! "), (52, "a"), (0, words(rng, 20))]
    rows = awkward()
    for n in range(60):
        item = rng.choice(items[:13])[1]
        k = rng.choice([0, 0, 1, 3, 5, 8, 12, 20, 30])
        rows.append((100 + n, f"{words(rng, 40)} {edited(rng, item, k).upper() if n % 3 else edited(rng, item, k)} {words(rng, 20)}"))
    rows += [(200 + n, words(rng, 80)) for n in range(20)]
    return rows, items


def brute(rows, items, rate):
    out = []
    for i, t in rows:
        found = []
        plain = f" {D.plain(t or '')} "
        for n, item in {(n, x) for n, x in items}:
            p = f" {D.plain(item or '')} "
            if p.strip() and (d := distance(p, plain)) <= int(len(p) * rate):
                found.append((n, d))
        out.append((i, bool(found), sorted({str(n) for n, _ in found}), min((d for _, d in found), default=None)))
    return sorted(map(str, out))


def items_frame(spark, items):
    return spark.createDataFrame([(n, t, "x") for n, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_matches_brute_force_whatever_the_blocks(spark, corpus, block_bytes):
    rows, items = corpus
    got = D.contamination(frame(spark, rows), items_frame(spark, items), block_bytes=block_bytes).collect()
    assert sorted(str((r["doc_id"], r["contaminated"], sorted(map(str, r["item_ids"])), r["min_distance"])) for r in got) == brute(rows, items, D.EDIT_RATE)


def test_drop_keeps_clean_rows_with_all_columns(spark, corpus):
    rows, items = corpus
    docs = frame(spark, rows)
    got = D.drop_contaminated(docs, items_frame(spark, items))
    assert got.columns == docs.columns
    bad = {x["doc_id"] for x in D.contamination(docs, items_frame(spark, items)).where("contaminated").collect()}
    clean = [r for r in docs.collect() if r["doc_id"] not in bad]
    assert sorted(map(str, got.collect())) == sorted(map(str, clean))


def test_empty_tables(spark, corpus):
    rows, items = corpus
    docs, bench = frame(spark, rows), items_frame(spark, items)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
