import random
import zlib

import numpy as np
import pytest
from corpus import awkward, frame, words

from fintally.llm import quality_mil as Q


def junk(rng, text):
    kind = rng.randrange(3)
    w = text.split()
    return " ".join(x + "###" for x in w) if kind == 0 else " ".join(x for x in w for _ in range(6)) if kind == 1 else " ".join(x.upper() + "!!" for x in w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    rows, labels = [], []
    for n in range(600):
        text = ". ".join(words(rng, 12).capitalize() for _ in range(rng.randrange(1, 20))) + "."
        bad = n % 5 == 0
        if bad and n % 10 == 0:  # the junk is in one part of the text
            text = text + " " + junk(rng, words(rng, 100))
        elif bad:
            text = junk(rng, text)
        rows.append((n, text))
        labels.append((n, 0 if bad else 1))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(i, q, "x") for i, q in labels], "doc_id long, quality int, text string")


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    got = Q.quality_scores(frame(spark, rows), label_frame(spark, labels)).collect()
    known = dict(labels)
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned_from(spark, corpus):
    rows, labels = corpus
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    docs = frame(spark, rows)
    a, b = (sorted(map(tuple, Q.quality_scores(docs, label_frame(spark, x), epochs=3).collect())) for x in (labels, flipped))
    assert a == b


def test_awkward_rows_and_missing_labels(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, awkward())
    odd = label_frame(spark, labels + [(None, 1), (1, None), (2, 0), (99_999, 0)])
    got = Q.quality_scores(docs, odd, epochs=2).collect()
    assert len(got) == len(awkward()) and all(r["held_out"] for r in got if r["doc_id"] is None)
    assert {r["score"] for r in Q.quality_scores(docs, label_frame(spark, labels).limit(0)).collect()} == {0.5}
    only = [(i, 1) for i, _ in awkward() if i is not None]
    assert {r["score"] for r in Q.quality_scores(docs, label_frame(spark, only)).collect()} == {1.0}
    assert Q.quality_scores(docs.limit(0), label_frame(spark, labels)).count() == 0
    kept = Q.keep_good(docs, label_frame(spark, only))
    assert kept.columns == docs.columns and kept.count() == len(awkward())


def test_sample_is_bounded(spark, corpus, monkeypatch):
    rows, labels = corpus
    seen = []
    monkeypatch.setattr(Q, "fit", lambda bags, y, **_: seen.append(len(y)) or Q.Constant(1.0))
    Q.train(frame(spark, rows), label_frame(spark, labels), sample_rows=50)
    assert seen == [50]


def test_gradients():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 2]
    x = rng.normal(size=(6, Q.N_FEATURES))
    starts, y = np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])
    model = Q.fit([x[a:a + n] for a, n in zip(starts, sizes)], y, epochs=2)
    w = model.weights

    def loss(v):
        p = Q.forward(v, x, starts)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    grad = Q.gradients(w, x, starts, y, 0)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grad[k][at]) < 1e-6


def test_passages():
    assert Q.passages("").shape == (1, Q.N_FEATURES) and not Q.passages(" \n").any()
    assert [len(Q.passages("w " * n)) for n in (1, 96, 97, 144, 192, 240)] == [1, 1, 1, 2, 2, 3]


def test_several_texts_of_an_id_in_any_order(spark):
    from fintally.llm import quality_mil as Q
    rows = [(i, f"text {t} of {i} " * (1 + (i + t) % 5)) for i in range(40) for t in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        scores.append(sorted((r["doc_id"], r["score"]) for r in Q.quality_scores(docs, labels, epochs=2).collect()))
    assert scores[0] == scores[1]
