"""The documents that match a set of items best, by reversed search: the items are indexed, the documents
stream through that index.

Items are few and documents many, so the inverted index holds the items: term -> items and how often they
hold it. It is broadcast, in blocks that are bounded in bytes; every block is a search of its own. One pass
over the texts counts terms and keeps those that some item holds; the corpus statistics (documents, terms,
document frequencies) come from that table and cover every document. A second pass over the table adds
every document's term weights to its items' scores and offers them to a heap per item, which keeps the best
``k``; the heaps of all tasks are merged in two steps by a top-k window, so no task meets more than the
heaps of some of the tasks.

Scores are integers throughout (see ``weights`` and ``length_part``), so they don't depend on any order.

Defined cases: null and empty texts hold no term, match nothing and are not counted in N; an item
without terms has no row; items alike in item_id and text are one, items that share only the item_id are
ranked each; each document row counts and is ranked by itself, also a repeated one; a null doc_id ranks
behind all others of its score; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

#: Bytes of item texts in one block of the index: some MB as postings, a few hundred MB at the worst.
BLOCK_BYTES = 4 << 20
#: Postings, and cells of the table documents x items, that are worked on at once.
STEP = 1 << 21
#: Groups of tasks whose heaps are merged first.
GROUPS = 64

#: Bytes of a term: digits, letters (A-Z as a-z) and all bytes of non-ASCII characters; others separate terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TABLE).split()


class Index:
    """Inverted index of a block of items: postings of term t are rows first[t] to first[t + 1]."""

    def __init__(self, items: list[tuple[object, bytes]]):
        held = [(i, Counter(terms(text))) for i, (_, text) in enumerate(items)]
        self.ids = [item_id for item_id, _ in items]
        self.terms = {t: n for n, t in enumerate(sorted({t for _, c in held for t in c}))}
        postings = sorted((self.terms[t], i, q) for i, c in held for t, q in c.items())
        self.item = np.array([p[1] for p in postings], np.int64)
        self.times = np.array([p[2] for p in postings], np.int64)
        self.first = np.searchsorted(np.array([p[0] for p in postings], np.int64), np.arange(len(self.terms) + 1))


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """(item_id, text) in blocks bounded in bytes, dealt by a hash; the driver holds one at a time."""
    items = items.select("item_id", common.whole_text().cast("binary").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = [(r["item_id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def term_counts(docs: DataFrame, index, text: str, doc_id: str) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs (the index' terms that the text holds, and how often), for
    every document with a term."""
    def count(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> pa.RecordBatch:
        n, ids, tfs, at = [], [], [], [0]
        for t in batch.column(1):
            found = terms(t.as_py())
            n.append(len(found))
            for term, tf in Counter(found).items():
                if (i := vocabulary.get(term)) is not None:
                    ids.append(i)
                    tfs.append(tf)
            at.append(len(ids))
        at = pa.array(at, pa.int32())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                                pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), common.whole_text(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([common.field(rows, "doc_id"), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return common.map_arrow(rows, count, schema, lambda: Index(index.value).terms).where("n > 0")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each term by the number of documents that hold it (0: no document asks for it)."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    """What a document's length adds to the denominator, in hundredths of the mean length."""
    return 100 - 75 + (75 * n * n_docs) // n_terms


class Heaps:
    """The ``k`` best documents of every item: highest score, then smallest doc_id."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n)], np.ones(n, np.int64)

    def offer(self, scores: np.ndarray, doc_ids: list) -> None:
        """scores[document, item]; documents without score are left out."""
        for d, i in zip(*np.nonzero(scores >= self.least)):
            heap, entry = self.heaps[i], (int(scores[d, i]), -math.inf if doc_ids[d] is None else -doc_ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def scores(index: Index, weight: np.ndarray, rows: list[int], n_rows: int, ids: np.ndarray, tfs: np.ndarray, part: np.ndarray) -> np.ndarray:
    """scores[document, item] of ``n_rows`` documents: entry e is term ids[e], tfs[e] times, of document rows[e]
    with length part part[e]."""
    gain = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * part))
    size = index.first[ids + 1] - index.first[ids]
    entry = np.repeat(np.arange(len(ids)), size)
    posting = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + index.first[ids][entry]
    out = np.zeros(n_rows * len(index.ids), np.int64)
    np.add.at(out, rows[entry] * len(index.ids) + index.item[posting], gain[entry] * index.times[posting])
    return out.reshape(n_rows, len(index.ids))


def best_of_tasks(counts: DataFrame, index, weight, n_docs: int, n_terms: int, k: int, item_id: T.StructField) -> DataFrame:
    """grp, item, item_id, doc_id, score: the heaps of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = Index(index.value), weight.value
        heaps = Heaps(len(held.ids), k)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            part = np.array([length_part(n, n_docs, n_terms) for n in batch.column(1).to_pylist()], np.int64)
            ids, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            work = np.concatenate([[0], np.cumsum(held.first[ids + 1] - held.first[ids])])[ends]  # postings up to each document
            a = 0
            while a < len(doc_ids):
                b = min(a + max(1, STEP // len(held.ids)), max(a + 1, int(np.searchsorted(work, work[a] + STEP, "right")) - 1), len(doc_ids))
                own = slice(int(ends[a]), int(ends[b]))
                rows = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                heaps.offer(scores(held, w, rows, b - a, ids[own], tfs[own], part[a:b][rows]), doc_ids[a:b])
                a = b
        out = [(i, held.ids[i], None if d == -math.inf else -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        if out:
            group = TaskContext.get().partitionId() % GROUPS
            columns = [[group] * len(out), *map(list, zip(*out))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    schema = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("item", T.IntegerType()), item_id, common.field(counts, "doc_id"), T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in schema]
    return counts.mapInArrow(run, schema)


def best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of every item with the highest scores above 0,
    equal scores by ascending doc_id. ``items`` has item_id and text; doc_id is an integer column."""
    sc = docs.sparkSession.sparkContext
    item_id = common.field(items, "item_id")
    out = None
    for block in item_blocks(items, block_bytes):
        index = sc.broadcast(block)  # at most block_bytes of text
        counts = common.written(term_counts(docs, index, text, doc_id), "term_counts")
        total = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        # one number for each term of the block
        frequency = np.zeros(len(Index(block).terms), np.int64)
        for i, df in counts.select(F.explode("ids").alias("i")).groupBy("i").count().toLocalIterator():
            frequency[i] = df
        weight = sc.broadcast(weights(frequency, total["docs"]))
        heaps = best_of_tasks(counts, index, weight, total["docs"], total["terms"], k, item_id)
        ranked = best(best(heaps, ["grp", "item"], k).drop("rank"), ["item"], k)
        found = ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType([item_id, T.StructField("rank", T.IntegerType()), common.field(docs, doc_id, "doc_id"), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    return out
