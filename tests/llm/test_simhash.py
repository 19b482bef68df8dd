import random
from collections import Counter

import pytest
import xxhash
from corpus import awkward, frame, words

from fintally.llm import simhash_bktree as S
from fintally.llm.components import components


def brute_print(text):
    import re
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=3):
    fps = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out[(d, f"{fps[i]:016x}", min(ids, default=None))] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = awkward() + [(-5, " nbsp is a letter"), (40, "a\x0bb c"), (41, "A b C")]
    for g in range(12):
        w = words(rng, 300).split()
        for c in range(6):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = "changed"
            out.append((1000 + rng.randrange(10_000), " ".join(v)))
    return out


def test_components_match_brute_force(spark, rows):
    got = S.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute_components(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert len({k[2] for k in want}) < len(rows) - 20  # there are groups


@pytest.mark.parametrize("radius,blocks", [(0, 1), (2, 3), (5, 6), (9, 10)])
def test_links_connect_what_brute_force_connects(spark, radius, blocks):
    rng = random.Random(radius)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for _ in range(rng.randrange(1, radius + 3)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = S.links(prints, radius, blocks).collect()
    mask = (1 << 64) - 1
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= radius for r in links)

    def classes(pairs):
        up = {v: v for v in signed}

        def top(v):
            while up[v] != v:
                v = up[v]
            return v
        for a, b in pairs:
            up[top(a)] = top(b)
        return {frozenset(v for v in signed if top(v) == t) for t in map(top, signed)}
    near = [(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= radius]
    assert classes((r["a"], r["b"]) for r in links) == classes(near)


def test_a_group_of_near_copies_gives_few_links():
    rng = random.Random(9)
    values = sorted({rng.getrandbits(64) & ~0xFF | rng.getrandbits(8) for _ in range(1)} | {0xABCD0000 | i for i in range(256)})
    assert len(S.forest(values, 3)) <= len(values) - 1


def test_bk_tree_search():
    rng = random.Random(6)
    tree, values = S.BKTree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for _ in range(100):
        q, r = rng.getrandbits(12), rng.randrange(6)
        assert sorted(tree.near(q, r)) == sorted({v for v in values if (v ^ q).bit_count() <= r})
    assert S.BKTree().near(1, 3) == []


def test_drop_near_duplicates(spark, rows):
    docs = frame(spark, rows)
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    want = {k[2] for k in brute_components(rows)}
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_empty(spark, rows):
    docs = frame(spark, rows).limit(0)
    assert S.near_duplicates(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0


def test_shards_across_batches(spark, rows):
    """Shards that end, go on or fill whole batches."""
    docs = frame(spark, rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size in (1, 2, 7):
        spark.conf.set(key, str(size))
        assert Counter(map(tuple, S.near_duplicates(docs, blocks=4).collect())) == brute_components(rows)
    spark.conf.set(key, before)


@pytest.mark.parametrize("remainder", [0, 50, 1 << 14])
def test_contraction_of_chains_stars_and_loops(spark, monkeypatch, remainder):
    monkeypatch.setattr("fintally.llm.components.REMAINDER", remainder)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6000, 6001), (6001, 6000), (None, 3)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert len(set(got.values())) == 3 and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
