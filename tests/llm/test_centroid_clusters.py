import hashlib
import math
import random

import numpy as np
import pytest

from fintally.llm import centroid_clusters as C


def brute(rows, dim, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if sum(x * x for x in v) <= 2 ** 62 / (2 * k + 2)]
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, cents)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = sum(d for *_, d in out)
    return sorted(((i, c, d, sum(e for _, b, e in out if b == c), inertia, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, -1) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, cluster int, v int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centre)]) for i in range(300)]
    out += [(400 + i, [float(round(x)) for x in rng.choice(centre)]) for i in range(60)]  # ties
    out += [(500 + i, out[7][1]) for i in range(150)] + [(7, out[7][1]), (None, out[9][1])]  # copies, repeated and null ids
    nan, inf = float("nan"), float("inf")
    out += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [nan] * 6), (605, [0.0] * 5 + [inf]), (606, [0.0] * 5 + [None]), (607, [1e300] * 6), (608, [3e5] + [0.0] * 5), (609, [-1e-9] * 6)]
    return out


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (40, 1)])
def test_clusters_equal_brute_force(spark, rows, k, rounds):
    got = C.cluster_report(frame(spark, rows).repartition(5), dim=6, k=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 6, k, rounds, 1024, 3)


def test_few_and_no_vectors(spark, rows):
    few = [(1, [0.0] * 6), (2, [1.0] * 6), (3, None)]
    assert sorted(map(tuple, C.cluster_report(frame(spark, few), dim=6).collect()), key=repr) == brute(few, 6, 8, 10, 1024, 3)
    for none in ([], [(1, [0.5])]):
        out = C.cluster_report(frame(spark, none), dim=6)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("n,dim,k,spread", [(400, 5, 30, 1000), (400, 2, 60, 6), (300, 64, 8, 50), (200, 1, 20, 40), (0, 3, 2, 9)])
def test_walk_finds_the_nearest_with_the_smaller_number(n, dim, k, spread):
    rng = np.random.default_rng(n + dim)
    cents, x = rng.integers(-spread, spread, (k, dim)), rng.integers(-spread, spread, (n, dim))
    who, least, met = C.nearest(x, C.Lists(cents.tolist()))
    table = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (who == table.argmin(axis=1)).all() and (least == table.min(axis=1)).all() if n else len(who) == 0
    if dim <= 2:
        assert met.mean() < k / 2  # the walk stops before it has met all


def test_walk_in_plain_steps():
    """The walk of one vector, step by step: how many centroids it meets."""
    rng = random.Random(6)
    for _ in range(60):
        cents = [[rng.randrange(-9, 9) for _ in range(3)] for _ in range(12)]
        x = [rng.randrange(-9, 9) for _ in range(3)]
        orders = [sorted(range(12), key=lambda c: abs(cents[c][d] - x[d])) for d in range(3)]
        met, best = set(), math.inf
        for depth in range(12):
            met |= {orders[d][depth] for d in range(3)}
            best = min(best, *(sum((a - b) ** 2 for a, b in zip(cents[c], x)) for c in met))
            if sum((cents[orders[d][depth]][d] - x[d]) ** 2 for d in range(3)) > best:
                break
        who, least, _ = C.nearest(np.array([x]), C.Lists(cents))
        assert least[0] == best and sum((a - b) ** 2 for a, b in zip(cents[who[0]], x)) == best
