"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention network, learned from
document labels alone, weighs the passages; the weighted passage representation is scored. Training
uses a bounded sample of labelled rows; scoring reads every passage of every text, map-only.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

PASSAGE_WORDS = 96
SAMPLE_ROWS = 4000  # labelled documents that are learned from, at every input size
THRESHOLD = 0.3

# classes of UTF-8 bytes: the encoder sees how a passage is written, in any language
SPACE, LINE, LOWER, UPPER, DIGIT, STOP, COMMA, QUOTE, SYMBOL, WIDE, CONTROL = range(11)
CLASSES = 11
CLASS = np.full(256, CONTROL, np.uint8)
CLASS[33:127] = SYMBOL
CLASS[[32, 9]] = SPACE
CLASS[[10, 11, 12, 13]] = LINE
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWER, UPPER, DIGIT, WIDE
CLASS[[ord(c) for c in ".!?"]], CLASS[[ord(c) for c in ",;:"]], CLASS[[ord(c) for c in "'\"()-"]] = STOP, COMMA, QUOTE
N_FEATURES = CLASSES * CLASSES + 6


def passages(text: str, size: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of features for each passage of ``size`` words; an empty text is one row of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = -(-len(words) // size)
    if n > 1 and len(words) - (n - 1) * size < size // 2:
        n -= 1  # a short rest joins the last passage
    which = np.minimum(np.arange(len(words)) // size, n - 1)
    count = np.bincount(which, minlength=n).astype(np.float64)
    mark = np.fromiter(map(hash, words), np.int64, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    again = np.zeros(len(words))
    again[1:] = (mark[1:] == mark[:-1]) & (which[1:] == which[:-1])
    order = np.lexsort((mark, which))
    m, w = mark[order], which[order]
    fresh = np.ones(len(words))
    fresh[1:] = (m[1:] != m[:-1]) | (w[1:] != w[:-1])
    out = np.zeros((n, N_FEATURES), np.float32)
    extra = CLASSES * CLASSES
    out[:, extra] = np.bincount(which, again, n) / count
    out[:, extra + 1] = np.bincount(w, fresh, n) / count
    out[:, extra + 2] = mean = np.bincount(which, length, n) / count
    out[:, extra + 3] = np.sqrt(np.maximum(np.bincount(which, length.astype(float) ** 2, n) / count - mean ** 2, 0))
    out[:, extra + 4] = np.bincount(which, length == 1, n) / count
    out[:, extra + 5] = np.log1p(count)
    kind = CLASS[np.frombuffer(text.encode(), np.uint8)]
    if len(kind) > 1:
        blank = kind <= LINE
        started = np.cumsum(~blank & np.concatenate(([True], blank[:-1])))  # words begun so far, by ASCII white space
        place = np.minimum(np.maximum(started - 1, 0) * len(words) // max(int(started[-1]), 1) // size, n - 1)[1:]
        pair = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
        pairs = np.bincount(place * extra + pair, minlength=n * extra).reshape(n, extra)
        out[:, :extra] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of bags; bag i is rows starts[i] up to starts[i + 1]."""
        return forward(self.weights, np.clip((x - self.mean) / self.scale, -6, 6), starts)[0]


@dataclass
class Constant:
    value: float

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts), self.value)


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def forward(w: dict, x: np.ndarray, starts: np.ndarray):
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return sigmoid(z @ w["score"] + w["score0"]), (bag, h, t, g, a, z)


def gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict:
    p, (bag, h, t, g, a, z) = forward(w, x, starts)
    d = (p - y) / len(y)
    dz = d[:, None] * w["score"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dgated = de[:, None] * w["attend"]
    dt, dg = dgated * g * (1 - t * t), dgated * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
    out = {"encode": x.T @ dh, "encode0": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ de, "score": z.T @ d, "score0": d.sum(keepdims=True)}
    return {k: v + decay * w[k] for k, v in out.items()}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7):
    """A model learned with Adam; a constant if there are no labels or only one."""
    if len(y) == 0 or y.min() == y.max():
        return Constant(float(y[0]) if len(y) else 0.5)
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    size = np.array([len(b) for b in bags])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    x = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    w = {"encode": rng.normal(0, 0.1, (N_FEATURES, hidden)), "encode0": np.zeros(hidden), "tanh": rng.normal(0, 0.2, (hidden, attention)),
         "gate": rng.normal(0, 0.2, (hidden, attention)), "attend": rng.normal(0, 0.2, attention), "score": rng.normal(0, 0.2, hidden), "score0": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick, step = order[at:at + batch], step + 1
            rows = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in pick])
            grad = gradients(w, x[rows], np.concatenate(([0], np.cumsum(size[pick])[:-1])), y[pick], decay)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options):
    """Learns from at most ``sample_rows`` labelled rows that are not held out, those with the smallest
    hashes of their ids; of several labels of an id the smallest counts. The features of the sample's
    texts are made on the executors; the driver gets these alone."""
    known = (labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    sample = docs.select(F.col(doc_id).alias("__id"), common.whole_text(text).alias("__text")).join(F.broadcast(known), "__id").select(F.col("__id").cast("string").alias("i"), F.col("__y").cast("double").alias("y"), "__text", common.text_mark("__text").alias("mark"))
    out = T.StructType([T.StructField("i", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType()), T.StructField("mark", T.LongType())])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([passages(t.as_py()).tobytes() for t in batch.column(2)], pa.binary()), batch.column(3)], out.names)

    # an id can have several texts: the one with the smallest mark counts, whatever the order of rows
    first = common.map_arrow(sample, encode, out).groupBy("i").agg(F.min(F.struct("mark", "y", "x")).alias("r")).select("i", "r.y", "r.x")
    rows = sorted((r["i"], r["y"], bytes(r["x"])) for r in first.collect())
    return fit([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, _, x in rows], np.array([y for _, y, _ in rows]), **options)


def scored(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with the column __score. Columns other than the text pass untouched."""
    names = docs.columns
    src = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], common.whole_text(text).alias("__text"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema[:-1]] + [T.StructField("__score", T.DoubleType())])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = []
        for at in range(0, batch.num_rows, 256):
            bags = [passages(t) for t in batch.column(len(names)).slice(at, 256).to_pylist()]
            starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
            values.append(model.scores(np.concatenate(bags).astype(np.float64), starts))
        return pa.record_batch([*batch.columns[:-1], pa.array(np.clip(np.concatenate(values), 0, 1), pa.float64())], out.names)

    return common.map_arrow(src, score, out).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], "__score")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts are one empty passage and get a score too; repeated rows are scored each, and of several
    texts of a labelled id the one with the smallest mark is learned from. An empty table gives no rows. With no labels every score is 0.5; with one label only, that label. A null doc_id counts as held out."""
    model = train(docs, labels, text, doc_id, **options)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = scored(src, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted 1."""
    return scored(docs, train(docs, labels, text, doc_id, **options), text).where(F.col("__score") >= threshold).drop("__score")
