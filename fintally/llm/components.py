"""Connected components of a graph given as edges, by repeated contraction.

In every round each vertex picks the neighbour (or itself) with the smallest rank, ranks being drawn
anew from a hash, and is merged into it; edges are carried over to the merged vertices. A round takes
off a constant share of the vertices in expectation, whatever the shape of the graph, so long chains
take as few rounds as stars. When a bounded number of edges is left, one task finishes them instead of
further rounds of small jobs. Nothing is collected but the number of edges left.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.llm.common import cut_lineage

#: Edges that one task finishes: some hundred KB, whatever the size of the graph.
REMAINDER = 1 << 14


def finished(edges: DataFrame) -> DataFrame:
    """v, root of a bounded number of edges, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up[top(a)] = top(b)
        yield pa.record_batch([pa.array(list(up), pa.int64()), pa.array([top(v) for v in list(up)], pa.int64())], ["v", "root"])
    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, root long")


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of ``edges`` (columns a, b: longs): vertices have the same root exactly
    if they are connected. Loops, repeated edges and either direction are fine; edges with a null are
    dropped; no edges give no rows."""
    def clean(e: DataFrame) -> DataFrame:
        e = e.where("a <> b")
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, steps = cut_lineage(clean(edges)), []
    while (n := left.count()) > REMAINDER:
        seed = len(steps)
        both = left.select("a", "b").union(left.select("b", "a"))
        rank = F.struct(F.xxhash64("b", F.lit(seed)).alias("r"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64("a", F.lit(seed)).alias("r"), F.col("a").alias("v"))
        step = cut_lineage(both.groupBy("a").agg(F.min(F.least(rank, own)).alias("m")).select(F.col("a").alias("v"), F.col("m.v").alias("root")))
        steps.append(step)
        moved = left.join(step.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        left = cut_lineage(clean(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    if n:
        steps.append(cut_lineage(finished(left)))
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("v").alias("root"), F.col("root").alias("further"))
        # a plan of one join each: a chain over all rounds would be held, and planned anew at each of its stages, by the driver
        out = cut_lineage(step.join(later, "root", "left").select("v", F.coalesce("further", "root").alias("root")))
    return out
