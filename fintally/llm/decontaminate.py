"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k edits, k a fixed rate of m. Cut into k + 1 pieces, at least
one piece of any such copy is unharmed. One automaton over all pieces finds exact piece hits in a
document; the stretch around a hit is verified with Myers' bit-parallel edit distance.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

EDIT_RATE = 0.05
BLOCK_BYTES = 4 << 20  # of items in one automaton; more items are searched for in further blocks
APART = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower case, every stretch of what is neither letter nor digit one space."""
    return APART.sub(" ", text.lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int]:
    """The smallest edit distance of the pattern to a substring of the text, and where that substring
    ends; (k + 1, -1) if it is over k. One machine-word step per character, on integers of any length."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, at = k + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & ones
        pv = ((mh << 1) & ones) | (~(xv | ph) & ones)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                by_piece.setdefault(piece, []).append((n, offset))
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the plain text) of the best place of every item that is found."""
        found: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        padded = f" {text} "
        for end, (length, places) in self.automaton.iter(padded):
            for n, offset in places:
                start = end - length + 1 - offset  # of the item, if nothing were inserted or lost before the piece
                if (n, start) in seen or found.get(n, (1, 0))[0] == 0:
                    continue
                seen.add((n, start))
                _, item, k = self.items[n]
                if padded.startswith(item, max(start, 0)) and start >= 0:
                    found[n] = (0, start + len(item) - 1)
                    continue
                if k == 0:
                    continue
                a = max(0, start - k)
                distance, at = myers(item, padded[a:start + len(item) + k], k)
                if distance <= k and distance < found.get(n, (k + 1, 0))[0]:
                    found[n] = (distance, a + at - 1)
        return sorted((self.items[n][0], d, e) for n, (d, e) in found.items())


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items' plain texts, in blocks that are bounded in bytes: the driver never holds more than
    one. Items are dealt to blocks by a hash of their id and text."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = -(-total // block_bytes)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        rows = {(r["item_id"], f" {p} ") for r in part.collect() if (p := plain(r["text"]))}
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def searched(docs: DataFrame, items: DataFrame, text: str, doc_id: str, rate: float, block_bytes: int, keep: list[str]) -> DataFrame:
    """__id, __text, __keep0 ... (the columns ``keep``), __matches. One automaton a block of items; the
    documents are read once, whatever the number of blocks; no shuffle."""
    items = items.select("item_id", common.whole_text("text").alias("text")).distinct()
    entry = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kept = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)]
    df = docs.select(F.col(doc_id).alias("__id"), common.whole_text(text).alias("__text"), *kept, F.array().cast(T.ArrayType(entry)).alias("__matches"))
    last = len(df.columns) - 1
    for block in item_blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_bytes of text

        def search(batch: pa.RecordBatch, matcher: Matcher) -> pa.RecordBatch:
            had = batch.column(last).to_pylist()
            more = [before + [{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.matches(plain(t.as_py()))] for before, t in zip(had, batch.column(1))]
            return pa.record_batch([*batch.columns[:last], pa.array(more, batch.schema.field(last).type)], batch.schema.names)

        df = common.map_arrow(df, search, df.schema, lambda shared=shared: Matcher(shared.value, rate))
    return df


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, matches (item_id, distance, end) for each row.

    An item is found where the plain text holds it, at word ends, with at most ``rate`` edits per
    character. Items and texts that are null or hold no letter or digit match nothing; repeated rows
    are searched each; repeated items are one."""
    found = searched(docs, items, text, doc_id, rate, block_bytes, [])
    return found.select(F.col("__id").alias("doc_id"), F.col("__matches").alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted), min_distance (null if none) for each row."""
    found = find_items(docs, items, **options)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
                        F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), F.array_min("matches.distance").alias("min_distance"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    found = searched(docs, items, text, doc_id, rate, block_bytes, docs.columns)
    return found.where(F.size("__matches") == 0).select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(docs.columns)])
