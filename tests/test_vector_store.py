"""The stored vector table: searches, changes and the folders they touch."""
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fintally.operators import similarity as SI
from fintally.operators import vector_store as VS

SCHEMA = "transaction_id long, vector array<float>, merchant string, category string, amount double"


def _vectors(n=600, dim=8, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (groups, dim))
    return {i: (centres[rng.integers(groups)] + rng.normal(0, 0.3, dim)).astype(np.float32).tolist() for i in range(n)}


def _frame(spark, vectors):
    return spark.createDataFrame([(i, v, f"m{i}", "Shopping", float(i)) for i, v in vectors.items()], SCHEMA)


def _nearest(vectors, query, k, without=None):
    d = sorted((float(((np.array(v, np.float32).astype(float) - np.array(query, np.float32).astype(float)) ** 2).sum()), i) for i, v in vectors.items() if i != without)
    return [i for _, i in d[:k]]


def _found(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return out


def _queries(spark, vectors, ids):
    return spark.createDataFrame([(i, vectors[i]) for i in ids], "query_id long, vector array<float>")


def _state(path):
    """The files of every folder."""
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


@pytest.fixture
def store(spark, tmpdir_path):
    vectors = _vectors()
    path = os.path.join(tmpdir_path, "store")
    VS.create_store(_frame(spark, vectors), path, cell_rows=40)
    return path, vectors


def test_exact_search_equals_brute_force_and_reads_probed_cells(spark, store):
    path, vectors = store
    ids = list(range(0, 600, 7))
    got = _found(VS.search_store(spark, path, _queries(spark, vectors, ids), 5, probes=1, exact=True, exclude_self=True, block_rows=16))
    assert got == {i: _nearest(vectors, vectors[i], 5, i) for i in ids}
    one = VS.search_store(spark, path, _queries(spark, vectors, [0]), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert any("cell#" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])


def test_approximate_search_recall_and_k(spark, store):
    path, vectors = store
    ids = list(range(0, 600, 5))
    got = _found(VS.search_store(spark, path, _queries(spark, vectors, ids), 5, probes=3, exclude_self=True))
    hits = sum(len(set(got[i]) & set(_nearest(vectors, vectors[i], 5, i))) for i in ids)
    assert hits >= 0.9 * 5 * len(ids) and all(len(g) == 5 for g in got.values())
    few = _found(VS.search_store(spark, path, _queries(spark, vectors, [3]), 400, probes=1))
    assert len(few[3]) == 400  # more cells than asked for, until k are there


def test_changes_rewrite_only_their_cells(spark, store):
    path, vectors = store
    before = _state(f"{path}/vectors")
    changes = [(5, 1, "put", vectors[300], "Travel", "moved", 1.0), (6, 1, "delete", None, None, None, None), (7, 1, "recategorize", None, "Travel", None, None),
               (8, 2, "delete", None, None, None, None), (8, 1, "put", vectors[9], "Travel", "x", 1.0), (9000, 1, "put", vectors[10], "Travel", "new", 2.0),
               (9001, 1, "recategorize", None, "Travel", None, None), (9002, 1, "delete", None, None, None, None), (None, 1, "delete", None, None, None, None)]
    frame = spark.createDataFrame(changes, "transaction_id long, seq long, op string, vector array<float>, category string, merchant string, amount double")
    cells = VS.change_store(spark, path, frame)
    after = _state(f"{path}/vectors")
    assert 0 < len(cells) < len(before) / 2
    assert {d for d in before if before[d] != after[d]} <= {f"cell={c}" for c in cells}
    want = {i: (f"m{i}", "Shopping", float(i)) for i in vectors if i not in (6, 8)} | {5: ("moved", "Travel", 1.0), 7: ("m7", "Travel", 7.0), 9000: ("new", "Travel", 2.0)}
    rows = lambda: {r["transaction_id"]: (r["merchant"], r["category"], r["amount"]) for r in VS.stored_vectors(spark, path).collect()}
    assert rows() == want
    now = {i: v for i, v in vectors.items() if i not in (6, 8)} | {5: vectors[300], 9000: vectors[10]}
    assert _found(VS.search_store(spark, path, _queries(spark, now, [5, 9000, 7]), 4, probes=1, exact=True)) == {i: _nearest(now, now[i], 4) for i in (5, 9000, 7)}
    VS.change_store(spark, path, frame)  # run again
    assert rows() == want and VS.stored_vectors(spark, path).count() == len(want)


def test_cells_and_stores_can_become_empty(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "store")
    vectors = _vectors(20, 4, 3)
    VS.create_store(_frame(spark, vectors), path, cell_rows=4)
    gone = spark.createDataFrame([(i, 1, "delete", None, None, None, None) for i in vectors], "transaction_id long, seq long, op string, vector array<float>, category string, merchant string, amount double")
    VS.change_store(spark, path, gone)
    q = _queries(spark, vectors, [1])
    assert VS.stored_vectors(spark, path).count() == 0 and VS.search_store(spark, path, q, 3, exact=True).count() == 0
    back = gone.withColumn("op", F.lit("put")).withColumn("vector", F.array(*[F.lit(float(x)).cast("float") for x in vectors[1]]))
    VS.change_store(spark, path, back)
    assert _found(VS.search_store(spark, path, q, 3))[1] == [0, 1, 2]


def test_live_and_popular_cells(spark, store):
    path, vectors = store
    live = spark.createDataFrame([(i,) for i in range(0, 600, 2)], "transaction_id long")
    some = {i: v for i, v in vectors.items() if i % 2 == 0}
    got = _found(VS.search_store(spark, path, _queries(spark, vectors, [1, 3]), 6, probes=1, exact=True, live=live))
    assert got == {i: _nearest(some, vectors[i], 6) for i in (1, 3)}
    # a third of all queries in one cell: its queries are cut by its own number
    rng = random.Random(1)
    ids = [rng.randrange(600) for _ in range(40)]
    many = spark.createDataFrame([(n, vectors[0]) for n in range(80)] + [(1000 + n, vectors[i]) for n, i in enumerate(ids)], "query_id long, vector array<float>")
    got = _found(VS.search_store(spark, path, many, 3, probes=1, exact=True, block_rows=8))
    assert got == {n: _nearest(vectors, vectors[0], 3) for n in range(80)} | {1000 + n: _nearest(vectors, vectors[i], 3) for n, i in enumerate(ids)}


def test_search_cells_blocks_by_cell(spark):
    asked = spark.createDataFrame([(i, [float(i)], [0] if i % 3 else [0, 1]) for i in range(30)], "qid long, qv array<float>, cells array<int>")
    base = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(40)], "bid long, bv array<float>, cell int")
    got = {(r["qid"], r["bid"]) for r in SI.search_cells(asked, base, {0: 20, 1: 20}, {0: 30, 1: 10}, 100, False, 6).collect()}
    assert got == {(q, b) for q in range(30) for b in range(40) if b % 2 == 0 or q % 3 == 0}


def test_exact_search_sends_a_query_once_to_a_pack_of_cells(spark, tmpdir_path, monkeypatch):
    rng = np.random.default_rng(8)  # without groups most cells can hold neighbours
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(800)}
    VS.create_store(_frame(spark, vectors), tmpdir_path, cell_rows=20)
    sent = []
    inner = SI.search_cells
    monkeypatch.setattr(SI, "search_cells", lambda asked, *a: sent.append(asked.select(F.sum(F.size("cells"))).first()[0]) or inner(asked, *a))
    ids = list(range(0, 800, 40))
    got = _found(VS.search_store(spark, tmpdir_path, _queries(spark, vectors, ids), 5, probes=2, exact=True))
    assert got == {i: _nearest(vectors, vectors[i], 5) for i in ids}
    assert sum(sent) <= len(ids)  # all cells fit one pack
    assert VS.packed(np.array([3, 0, 4, 9, 1, 1]), 8).tolist() == [0, 0, 0, 1, 2, 2]
