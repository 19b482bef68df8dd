"""SimHash near-duplicates with sharded BK-trees.

Fingerprints of 64 bits are cut into blocks; two that differ in at most r bits agree on all but r of
the blocks, so fingerprints are dealt to one shard for every choice of the blocks that may agree. Each
shard builds a BK-tree (children keyed by their Hamming distance to the parent), and every fingerprint
follows only the edges within the radius of its distance. A shard keeps a spanning forest of its links,
so a group of n near copies gives under n links in a shard; components then follow by contraction.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common
from fintally.llm.components import components

SPACES = bytes([32, 9, 10, 11, 12, 13])
BLOCKS = 5


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text: a bit is 1 if more than half of the hashes have it."""
    words = text.encode().lower().split()  # on bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(words[i:i + shingle]), seed) for i in range(n)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((ones * 2 > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


class BKTree:
    """Distinct fingerprints; a node is [value, {distance: child}]."""

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[0])
            children = node[1]
            if children:
                stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``radius`` bits connect among the values; under one a
    value."""
    up = {v: v for v in values}

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    tree, links = BKTree(), []
    for v in values:
        for w in tree.near(v, radius):
            a, b = top(v), top(w)
            if a != b:
                up[a] = b
                links.append((v, w))
        tree.add(v)
    return links


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for every choice of ``blocks - radius`` blocks: the choice and the bits in them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in pick) for pick in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def links(prints: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that connect all within the radius."""
    sharded = (prints.select("fp").distinct().select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("k"))
               .select(F.xxhash64("k.choice", "k.bits").alias("k"), "fp"))
    dealt = sharded.repartition("k").sortWithinPartitions("k", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, prints_: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                out += forest(prints_[s:e].tolist(), radius)
            if out:
                a, b = np.array(out, np.uint64).view(np.int64).T
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # batches of a shard that may go on
        for batch in batches:
            key, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = int(np.searchsorted(key, key[-1]))
            if held and (last or held[-1][0][-1] != key[-1]):
                held.append((key[:last], value[:last]))
                yield from found(*map(np.concatenate, zip(*held)))
                held = []
            elif last:
                yield from found(key[:last], value[:last])
            held.append((key[last:], value[last:]))
        if held:
            yield from found(*map(np.concatenate, zip(*held)))

    return dealt.mapInArrow(search, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int, extra: list[Column] = []) -> DataFrame:
    src = docs.select(F.col(doc_id).alias("doc_id"), common.whole_text(text).alias("text"), *extra)
    names = [c for c in src.columns if c != "text"]
    out = T.StructType([src.schema[c] for c in names] + [T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(fps)], [*names, "fp"])

    return common.map_arrow(src, run, out)


def groups(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, component_id: the smallest doc_id that is linked to it, over any number of links. Only
    fingerprints that are linked to another, or that several rows have, are listed."""
    owners = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    found = components(links(prints, radius, blocks))
    linked = owners.join(found.withColumnRenamed("v", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    alone = owners.where("rows > 1").join(merged.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return merged.union(alone)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row.

    Null and empty texts have fingerprint zero and link like any other; fewer words than a shingle
    make one shingle. component_id is the smallest doc_id reachable over links of at most ``radius``
    bits (null only if all are null). Repeated rows are returned each; other columns are not read."""
    prints = common.cut_lineage(fingerprints(docs, text, doc_id, shingle))
    return with_component(prints, groups(prints, radius, blocks)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_component(prints: DataFrame, grouped: DataFrame) -> DataFrame:
    grouped = grouped.withColumn("grouped", F.lit(True))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.join(grouped, "fp", "left").withColumn("component_id", component)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one whose doc_id is the
    component's; of rows that repeat that doc_id, the one with the smallest mark of its text."""
    prints = common.cut_lineage(fingerprints(docs, text, doc_id, shingle, [common.text_mark(text).alias("mark")]))
    member = with_component(prints, groups(prints, radius, blocks)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = member.groupBy("component_id").agg(F.min("mark").alias("__mark")).select(F.col("component_id").alias("__id"), "__mark")
    marked = docs.withColumn("__text_mark", common.text_mark(text))
    rows = marked.join(stays, (F.col("__text_mark") == F.col("__mark")) & F.col(doc_id).eqNullSafe(F.col("__id")))
    return rows.dropDuplicates(["__id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])
