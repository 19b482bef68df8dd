import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, frame, words

from fintally.llm import suffix_dedup as D


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[(i, len(b), sum(gone), gone.count(b"\0\1") + gone.startswith(b"\1"), hashlib.sha256(kept).hexdigest())] += 1
    return out


def result(df):
    rows = df.collect()
    for r in rows:
        assert all(a["to"] < b["from"] for a, b in zip(r["removed"], r["removed"][1:])) and sum(x["to"] - x["from"] for x in r["removed"]) == r["n_removed"]
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    passage = [words(rng, 60) for _ in range(4)]
    out = awkward() + [(400, "ab" * 700), (401, "y" * 200), (402, "z" * 199), (403, "y" * 200), (404, "q" * 201)]
    for n in range(60):
        p = rng.choice(passage)
        a = rng.randrange(0, 100)
        out.append((500 + n, f"{words(rng, rng.randrange(0, 40))} {p[a:]} {words(rng, 30)} {rng.choice(passage)[:rng.randrange(150, 400)]}"))
    return out


@pytest.mark.parametrize("shard_runs", [4096, 2])
def test_matches_brute_force_with_whole_and_split_shards(spark, rows, shard_runs):
    assert result(D.remove_repeated_bytes(frame(spark, rows), shard_runs=shard_runs)) == brute(rows, 200)


def test_other_lengths(spark):
    rng = random.Random(2)
    rows = [(n, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for n in range(60)]
    for length, gram in ((12, 4), (16, 16), (9, 1)):
        assert result(D.remove_repeated_bytes(frame(spark, rows), length=length, gram=gram, shard_runs=3)) == brute(rows, length)
    with pytest.raises(ValueError):
        D.remove_repeated_bytes(frame(spark, rows), length=400, gram=32)


def test_empty_table(spark, rows):
    assert D.remove_repeated_bytes(frame(spark, rows).limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for trial in range(100):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if trial % 3 == 0:
            segments = [rng.choice(segments) for _ in range(5)]
        sizes = np.array([len(s) for s in segments])
        stop = np.cumsum(sizes)
        data, end = np.frombuffer(b"".join(segments), np.uint8), np.repeat(stop, sizes)
        suffix = [bytes(data[i:end[i]]) for i in range(len(data))]
        order = D.suffix_array(data, end)
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = D.common_prefixes(data, end, order, stop - sizes)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while n < min(len(suffix[a]), len(suffix[b])) and suffix[a][n] == suffix[b][n]:
                n += 1
            assert shared[b] == n
        count = Counter(s[i:i + 4] for s in segments for i in range(len(s) - 3))
        assert [list(f) for f in D.repeated_stretches(segments, 4)] == [[count[s[i:i + 4]] > 1 for i in range(len(s) - 3)] for s in segments]


def test_merge_finds_stretches_of_two_lists():
    def listed(*rows):
        return np.array(sorted(rows), np.uint64).tobytes()
    got = set(D.merged([listed((1, 1, 10, 0), (2, 2, 10, 1)), listed((2, 2, 11, 5), (3, 3, 11, 6)), listed((4, 4, 12, 0), (3, 3, 12, 1), (2, 2, 12, 2))]))
    assert got == {(10, 1), (11, 5), (12, 2), (11, 6), (12, 1)}
    assert set(D.merged([listed((7, 7, 1, 1))])) == set()
