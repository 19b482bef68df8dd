import math
import random
import re
from collections import Counter

import pytest
from corpus import awkward, frame, words

from fintally.llm import lexical_search as S


def brute_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, k=10):
    counts = [(d, Counter(brute_terms(t))) for d, t in rows]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item_id, text in set(items):
        ranked = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in brute_terms(text) if t in c)
            if s > 0:
                ranked.append((-s, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(ranked)[:k], 1):
            out[(item_id, rank, d, -s)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = awkward() + [(d, words(rng, rng.randrange(1, 90), 30)) for d in range(100, 500)]
    same = words(rng, 25, 30)
    out += [(d, same) for d in range(900, 930)] + [(None, same), (900, same)]  # ties, repeated and null ids
    return out + [(950, "0 9 a z Z \x7f ~ ÉÀ é"), (951, "don't stop-now 3.14"), (952, same + " " + words(rng, 30_000, 30))]


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(8)
    out = [(i, words(rng, 20, 30)) for i in range(12)] + [(20, rows[-4][1]), (21, "DON'T stop"), (22, "z z z z 9"), (23, None), (24, ""), (25, "?!"), (26, "nowhereatall"),
                                                          (20, rows[-4][1]), (27, "É à"), (None, "the letter"), (0, "the other text of item nought")]
    return out


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "clash", -1.0) for i, t in items], "item_id long, text string, doc_id string, score double")


@pytest.mark.parametrize("block_bytes", [1 << 22, 700])
def test_search_equals_brute_force(spark, rows, items, block_bytes):
    got = S.search(frame(spark, rows).repartition(5), item_frame(spark, items), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(rows, items)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_small_steps_and_other_k(spark, rows, items, monkeypatch):
    index = S.Index([(i, (t or "").encode()) for i, t in items])
    monkeypatch.setattr(S, "STEP", 40)
    got = S.search(frame(spark, rows), item_frame(spark, items), k=3)
    assert Counter(map(tuple, got.collect())) == brute(rows, items, 3)
    assert len(index.first) == len(index.terms) + 1 and index.first[-1] == len(index.item)


def test_heaps_keep_the_best():
    import numpy as np
    rng = random.Random(1)
    heaps, seen = S.Heaps(2, 4), [[], []]
    for _ in range(30):
        ids = [rng.choice([None, rng.randrange(50)]) for _ in range(7)]
        table = np.array([[rng.randrange(6) for _ in range(2)] for _ in ids])
        heaps.offer(table, ids)
        for i in range(2):
            seen[i] += [(int(s), -math.inf if d is None else -d) for s, d in zip(table[:, i], ids) if s > 0]
    assert [sorted(h) for h in heaps.heaps] == [sorted(x)[-4:] for x in seen]


def test_empty_tables(spark, rows, items):
    assert S.search(frame(spark, []), item_frame(spark, items)).collect() == []
    none = S.search(frame(spark, rows), item_frame(spark, []))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert S.search(frame(spark, [(1, None), (2, "...")]), item_frame(spark, items)).collect() == []
