"""Exact duplicates by Patricia tries.

Texts are dealt by length and content hash. Each map task first gathers its own copies in a trie, so
a text that a third of all rows share leaves a task once; each reduce task inserts the full byte
strings into compressed radix tries whose terminal nodes hold the owner (the largest doc_id), the
number of rows and the digest. A trie over its budget spills its largest subtree. Members find their
owner by a join on the digest, so no task ever holds a group's members.
"""
from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

TRIE_BYTES = 32 << 20


class Node:
    __slots__ = ("label", "children", "end", "spill")

    def __init__(self, label: bytes, end=None):
        self.label, self.children, self.end, self.spill = label, {}, end, None


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def larger(a, b):
    """The larger id; null only if both are."""
    return b if a is None else a if b is None else max(a, b)


class Patricia:
    """Compressed radix trie over byte strings. ``end`` of a node: [owner, rows, digest] of the string
    that ends there. Subtrees beyond ``budget`` bytes of labels go to a temporary file of the task."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held = Node(b""), budget, 0

    def insert(self, s: bytes, owner, rows: int, digest) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((s[at:], owner, rows, digest), node.spill)
                return
            if at == len(s):
                node.end = [larger(node.end[0], owner), node.end[1] + rows, digest] if node.end else [owner, rows, digest]
                return
            child = node.children.get(s[at])
            if child is None:
                node.children[s[at]] = Node(s[at:], [owner, rows, digest])
                self.held += len(s) - at + 200
                break
            n = shared(child.label, s, at)
            if n < len(child.label):
                upper = Node(child.label[:n])
                upper.children[child.label[n]] = child
                child.label = child.label[n:]
                node.children[s[at]] = upper
                child = upper
                self.held += 200
            node, at = child, at + n
        while self.held > self.budget and self.spill_largest():
            pass

    def spill_largest(self) -> bool:
        """Sends the largest subtree below the first branching to a file. False: nothing to gain."""
        top = self.root
        while len(top.children) == 1 and top.end is None and top.spill is None:
            top = next(iter(top.children.values()))
        sizes = {k: sum(len(n.label) + 200 for n, _ in walk(c)) for k, c in top.children.items() if c.spill is None and c.children}
        if not sizes:
            return False
        node = top.children[max(sizes, key=sizes.get)]
        file = tempfile.TemporaryFile()
        for below, suffix in walk(node, b""):
            if below.end:
                pickle.dump((suffix, *below.end), file)
            if below.spill is not None:
                for more, *end in read(below.spill):
                    pickle.dump((suffix + more, *end), file)
        node.children, node.end, node.spill = {}, None, file
        self.held -= sizes[node_key(top, node)]
        return True

    def ends(self) -> Iterator[list]:
        """[owner, rows, digest] of each string; spilled subtrees are read back one at a time."""
        for node, _ in walk(self.root):
            if node.end:
                yield node.end
            if node.spill is not None:
                part = Patricia(self.budget)
                for s, owner, rows, digest in read(node.spill):
                    part.insert(s, owner, rows, digest)
                yield from part.ends()


def node_key(parent: Node, node: Node) -> int:
    return next(k for k, c in parent.children.items() if c is node)


def walk(node: Node, prefix: bytes | None = None):
    """The nodes from ``node`` down; with ``prefix``, also the string from below ``node`` to each."""
    stack = [(node, prefix)]
    while stack:
        n, p = stack.pop()
        yield n, p
        stack += [(c, None if p is None else p + c.label) for c in n.children.values()]


def read(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


FIELDS = ("len", "h", "bytes", "owner", "rows", "digest")


def batches_of(rows, types: dict) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 1,024 rows, with the columns of ``types``."""
    rows = list(rows)
    for at in range(0, len(rows), 1024):
        columns = zip(*rows[at:at + 1024])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, keep_id, group_size of each text that two or more rows have."""
    src = docs.select(F.encode(common.whole_text(text), "utf-8").alias("bytes"), F.col(doc_id).alias("owner")).select(
        F.length("bytes").alias("len"), F.xxhash64("bytes").alias("h"), "bytes", "owner",
        F.lit(1).cast("long").alias("rows"), F.sha2("bytes", 256).alias("digest"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within a map task become one row; the trie is emptied when it is full."""
        trie, first, types = Patricia(trie_bytes), {}, {}
        for b in batches:
            types = {f.name: f.type for f in b.schema}
            for n, h, s, owner, rows, digest in zip(*(c.to_pylist() for c in b.columns)):
                first.setdefault(digest, (n, h, s))
                trie.insert(s, owner, rows, digest)
                if trie.held > trie_bytes // 2:
                    yield from batches_of(((*first[d], o, r, d) for o, r, d in trie.ends()), types)
                    trie, first = Patricia(trie_bytes), {}
        yield from batches_of(((*first[d], o, r, d) for o, r, d in trie.ends()), types)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The owners of the texts that were dealt here."""
        trie, types = Patricia(trie_bytes), {}
        for b in batches:
            types = {k: b.schema.field(k).type for k in ("owner", "rows", "digest")}
            for s, owner, rows, digest in zip(*(b.column(k).to_pylist() for k in ("bytes", "owner", "rows", "digest"))):
                trie.insert(s, owner, rows, digest)
        yield from batches_of((e for e in trie.ends() if e[1] > 1), types)

    common.short_batches(docs.sparkSession)
    out = T.StructType([src.schema[k] for k in ("owner", "rows", "digest")])
    return src.mapInArrow(gather, src.schema).repartition("len", "h").mapInArrow(settle, out).select(
        F.col("digest").alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. keep_id is the largest doc_id of the group (null only if all are
    null); of rows that repeat that doc_id one is kept. Other columns are not read; an empty table
    gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(common.whole_text(text), 256).alias("text_sha256"))
    # rows alike in id and text: counted before the join, so that one of them can be kept
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("alike"))
    joined = rows.join(owners(docs, text, doc_id, trie_bytes), "text_sha256", "left")
    single = F.col("group_size").isNull()
    out = joined.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "alike")
    place = F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))).alias("place")
    return out.select("doc_id", "keep_id", "group_size", place, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that exact_groups keeps. Whole rows are dealt by
    id and digest, so a hot text spreads over all tasks."""
    marked = docs.withColumn("__digest", F.sha2(common.whole_text(text), 256))
    kept = (exact_groups(docs, text, doc_id).groupBy("doc_id", "text_sha256")
            .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__alike"))
            .where("__kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "__alike"))
    rows = marked.join(kept, (F.col("__digest") == F.col("__sha")) & F.col(doc_id).eqNullSafe(F.col("__id")), "inner")
    back = [F.col(f"`{c}`") for c in docs.columns]
    repeated = rows.where("__alike > 1").dropDuplicates(["__id", "__sha"]).select(*back)
    return rows.where("__alike = 1").select(*back).unionByName(repeated)
