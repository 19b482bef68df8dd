"""Substring duplicates by suffix arrays of shards.

Every stretch of ``length`` bytes has an anchor: the leftmost smallest hash of the 32-byte strings in it.
Equal stretches have equal anchors, so a text is cut into runs of stretches with one anchor, and a run
is dealt to the shard of its anchor hash: equal stretches always meet, and no shard has to be
compared with another. Only runs whose anchor stands elsewhere too are looked at. If all runs of an
anchor are the same bytes, they are duplicates as they stand; of the others, one copy of each is
sent to a shard, which builds a suffix array (Larsson-Sadakane refinement) and its common prefixes
(Kasai). An anchor with more runs than a shard takes is split, and the sorted stretches of its
shards are merged by binary search.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

LENGTH, GRAM = 200, 32
SHARD_RUNS = 4096  # runs of one anchor in one shard
BITS = 21  # positions of one suffix array: under 2 ** 21
MASK = (1 << BITS) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every place, by doubling."""
    h, factor, step = data.astype(np.uint64) + np.uint64(1), ODD, 1
    while step < gram:
        h = h[:-step] * factor + h[step:]
        factor = np.uint64(int(factor) ** 2 & (1 << 64) - 1)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchored_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first stretch and number of stretches of every run of a text."""
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    span, step, low = length - gram + 1, 1, h
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[:step - span], low[span - step:])
    new = np.ones(len(low), bool)
    # the anchor changes where the minimum does, and behind a stretch that began with its anchor
    new[1:] = (low[1:] != low[:-1]) | (h[:len(low) - 1] == low[:-1])
    start = np.flatnonzero(new)
    return low[start], start, np.diff(np.append(start, len(low)))


def suffix_array(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``data``, each read up to end[i], the end of its segment. Prefix doubling
    that sorts again only groups of suffixes not told apart yet; equal suffixes stay side by side."""
    n = len(data)
    at = np.arange(n, dtype=np.int64)
    key = np.zeros(n, np.int64)
    for k in range(4):
        inside = at + k < end
        key = key << 9 | np.where(inside, data[np.minimum(at + k, n - 1)].astype(np.int64) + 1, 0)
    packed = np.sort(key << BITS | at)
    order, group = packed & MASK, packed >> BITS
    head = np.concatenate(([True], group[1:] != group[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    slots = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    h, longest = 4, int((end - at).max(initial=0))
    while len(slots) and h < longest:
        i = order[slots]
        j = i + h
        follow = np.where(j < end[i], rank[np.minimum(j, n - 1)] + 1, 0)
        packed = np.sort(rank[i] << 2 * BITS | follow << BITS | i)
        i, group = packed & MASK, packed >> BITS
        head = np.concatenate(([True], group[1:] != group[:-1]))
        order[slots] = i
        rank[i] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.concatenate((head[1:], [True])))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every place, the length that its suffix shares with the one before it in ``order``. Kasai's
    walk, for all segments (from ``starts``) side by side: a step right loses at most one."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(np.uint64).ravel()
    starts = starts[np.argsort(starts - end[starts], kind="stable")]  # longest first
    sizes = end[starts] - starts
    held = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        lanes = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t
        i = starts[:lanes] + t
        p = before[i]
        h = np.where(p >= 0, np.maximum(held[:lanes] - 1, 0), 0)
        most = np.where(p >= 0, np.minimum(end[i] - i, end[p] - p), 0)
        go = np.flatnonzero(h + 8 <= most)
        while len(go):
            go = go[words[i[go] + h[go]] == words[p[go] + h[go]]]
            h[go] += 8
            go = go[h[go] + 8 <= most[go]]
        go = np.flatnonzero(h < most)
        while len(go):
            go = go[data[i[go] + h[go]] == data[p[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < most[go]]
        out[i], held[:lanes] = h, h
    return out


def repeated_stretches(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, whether the stretch of ``length`` bytes from each place of it stands at another
    place of the segments."""
    sizes = np.array([len(s) for s in segments])
    stop = np.cumsum(sizes)
    starts = stop - sizes
    data, end = np.frombuffer(b"".join(segments), np.uint8), np.repeat(stop, sizes)
    order = suffix_array(data, end)
    shared = common_prefixes(data, end, order, starts) >= length
    twice = shared.copy()
    twice[order[:-1]] |= shared[order[1:]]
    return [twice[a:max(a, b - length + 1)] for a, b in zip(starts.tolist(), stop.tolist())]


def ranges(flags: np.ndarray) -> list[int]:
    """from, to, from, to ... of the true stretches of ``flags``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.tolist()


# A run's place: 24 bits of its text's mark, first stretch, number of stretches less one.
def mark_of(place: Column) -> Column:
    return F.shiftrightunsigned(place, 40)


def start_of(place: Column) -> Column:
    return F.shiftrightunsigned(place, 8).bitwiseAND(F.lit((1 << 32) - 1))


def count_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(255)) + 1


def run_rows(src: DataFrame, length: int, gram: int) -> DataFrame:
    """a (anchor), g (hash of the run's bytes), rid, place of every run."""
    out = T.StructType([T.StructField(k, T.LongType()) for k in ("a", "g", "rid", "place")])

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        digest = xxhash.xxh3_64_intdigest
        for rid, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = text.as_buffer()
            view = memoryview(data) if data is not None else memoryview(b"")
            a, start, n = anchored_runs(view, length, gram)
            if len(a):
                stop = start + n + length - 1
                parts[0].append(a)
                parts[1].append(np.fromiter((digest(view[i:j]) for i, j in zip(start.tolist(), stop.tolist())), np.uint64, len(a)))
                parts[2].append(np.full(len(a), rid, np.int64))
                parts[3].append(np.int64(mark) << np.int64(40) | start << 8 | n - 1)
        if not parts[0]:
            return None
        return pa.record_batch([pa.array(np.concatenate(p).view(np.int64)) for p in parts], out.names)

    return common.map_arrow(src.select("rid", "mark", "bytes"), emit, out)


def shard_results(segments: DataFrame, length: int) -> DataFrame:
    """a, g, cuts (ranges of repeated stretches in the run) for runs that have some; for anchors that
    are split over shards also, by bucket of their digests, the shard's sorted stretches."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("g", T.LongType()), T.StructField("cuts", T.ArrayType(T.IntegerType())),
                        T.StructField("bucket", T.IntegerType()), T.StructField("stretches", T.BinaryType())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, []

        def shard() -> Iterator[pa.RecordBatch]:
            found = []
            for (a, _, g, _, data), flags in zip(held, repeated_stretches([h[4] for h in held], length) if held else ()):
                if flags.any():
                    found.append((a, g, ranges(flags), None, None))
            for a, bucket, run in exported([h for h in held if h[3] > 1], length):
                found.append((a, None, None, bucket, run))
            held.clear()
            if found:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], out.names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # a whole group (anchor, part) goes into one suffix array
                if group and row[:2] != group[0][:2]:
                    if size + sum(len(r[4]) for r in group) >= MASK and held:
                        yield from shard()
                        size = 0
                    held += group
                    size += sum(len(r[4]) for r in group)
                    group = []
                if not group or group[-1][2] != row[2]:  # a repeated row brings the same run twice
                    group.append(row)
        if held and size + sum(len(r[4]) for r in group) >= MASK:
            yield from shard()
        held += group
        yield from shard()

    return segments.select("a", "part", "g", "parts", "bytes").sortWithinPartitions("a", "part", "g").mapInArrow(search, out)


def exported(rows: list[tuple], length: int) -> Iterator[tuple[int, int, bytes]]:
    """Of runs of split anchors: anchor, bucket, and the stretches of the bucket sorted by digest."""
    by: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for a, _, g, parts, data in rows:
        for i in range(len(data) - length + 1):
            d = xxhash.xxh3_128_intdigest(data[i:i + length])
            by.setdefault((a, d % parts), []).append((d >> 64, d & (1 << 64) - 1, g & (1 << 64) - 1, i))
    for (a, bucket), found in by.items():
        yield a, bucket, np.array(sorted(found), np.uint64).tobytes()


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """(run, stretch) of the stretches that stand in two of the sorted lists, by binary search of each
    list in what the earlier ones hold."""
    seen = np.empty((0, 4), np.uint64)
    known = np.empty(0, bool)
    for data in runs:
        more = np.frombuffer(data, np.uint64).reshape(-1, 4)
        first = np.searchsorted(seen[:, 0], more[:, 0])
        inside = np.minimum(first, max(len(seen) - 1, 0))
        hit = (seen[inside, 0] == more[:, 0]) & (seen[inside, 1] == more[:, 1]) if len(seen) else np.zeros(len(more), bool)
        known[inside[hit]] = True
        seen, known = np.concatenate((seen, more)), np.concatenate((known, hit))
        order = np.argsort(seen[:, 0], kind="stable")
        seen, known = seen[order], known[order]
        # equal stretches stand side by side: what one of them knows, all know
        same = (seen[1:, 0] == seen[:-1, 0]) & (seen[1:, 1] == seen[:-1, 1])
        block = np.concatenate(([0], np.cumsum(~same)))
        known = np.bincount(block, known)[block] > 0
    for _, _, g, i in seen[known].tolist():
        yield g - (1 << 64) if g >> 63 else g, i


def merge_split(results: DataFrame) -> DataFrame:
    """a, g, cuts of the stretches that shards of one anchor share."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("g", T.LongType()), T.StructField("cuts", T.ArrayType(T.IntegerType()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            by_run: dict[int, list[int]] = {}
            for g, i in merged(runs):
                by_run.setdefault(g, []).extend((i, i + 1))
            if by_run:
                found = [(key[0], g, cuts) for g, cuts in by_run.items()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], out.names)

        for batch in batches:
            for a, bucket, run in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (a, bucket):
                    if runs:
                        yield from done()
                    key, runs = (a, bucket), []
                runs.append(run)
        if runs:
            yield from done()

    split = results.where("bucket is not null").select("a", "bucket", "stretches")
    return split.repartition("a", "bucket").sortWithinPartitions("a", "bucket").mapInArrow(search, out)


def duplicate_spans(src: DataFrame, length: int, gram: int, shard_runs: int) -> DataFrame:
    """rid, mark, spans (from, to) of the bytes that a repeated stretch covers."""
    rows = run_rows(src, length, gram)
    anchors = rows.groupBy("a").agg(F.count(F.lit(1)).alias("times"), (F.min("g") != F.max("g")).alias("mixed")).where("times > 1").select("a", "mixed")
    repeated = common.written(rows.join(common.written(anchors, "anchors"), "a"), "runs")

    mixed = repeated.where("mixed")
    kinds = mixed.groupBy("a", "g").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "place")).alias("one"))
    many = kinds.groupBy("a").count().where(F.col("count") > shard_runs).select("a", F.ceil(F.col("count") / shard_runs).cast("int").alias("parts"))
    wanted = (kinds.join(many, "a", "left").select("a", "g", F.coalesce("parts", F.lit(1)).alias("parts"), F.col("one.rid").alias("rid"), F.col("one.place").alias("place"))
              .select("*", F.pmod("g", "parts").cast("int").alias("part"), mark_of(F.col("place")).alias("mark")))
    asked = wanted.groupBy("rid", "mark").agg(F.collect_list(F.struct("a", "g", "parts", "part", start_of(F.col("place")).alias("start"), count_of(F.col("place")).alias("n"))).alias("asked"))
    texts = src.join(asked, ["rid", "mark"]).select("bytes", "asked")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("g", T.LongType()), T.StructField("parts", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("bytes", T.BinaryType())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(q["a"], q["g"], q["parts"], q["part"], data[q["start"]:q["start"] + q["n"] + length - 1])
                 for data, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for q in asked]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], out.names)

    segments = common.map_arrow(texts, cut, out).repartition("a", "part")
    results = common.written(shard_results(segments, length), "shards")
    cuts = results.where("cuts is not null").select("a", "g", "cuts").union(merge_split(results))
    cuts = cuts.groupBy("a", "g").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    whole = kinds.where("times > 1").select("a", "g")
    known = cuts.join(whole.withColumn("whole", F.lit(True)), ["a", "g"], "full").select("a", "g", "whole", "cuts")

    start, n = start_of(F.col("place")), count_of(F.col("place"))
    all_of = F.array(F.lit(0), n.cast("int"))
    found = repeated.where("not mixed").select("rid", "place", all_of.alias("cuts")).union(
        mixed.join(known, ["a", "g"]).select("rid", "place", F.when(F.col("whole"), all_of).otherwise(F.col("cuts")).alias("cuts")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2)), lambda i: F.struct(
        (start + F.get("cuts", i)).alias("from"), (start + F.get("cuts", i + 1) + (length - 1)).alias("to")))
    return found.select("rid", mark_of(F.col("place")).alias("mark"), pairs.alias("s")).groupBy("rid", "mark").agg(F.flatten(F.collect_list("s")).alias("spans"))


def joined_spans(size: int, spans) -> list[tuple[int, int]]:
    """The union of the spans, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, min(b, size)))
    return out


def kept_parts(data: bytes, gone: list[tuple[int, int]]) -> list[bytes]:
    at, parts = 0, []
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    return [*parts, data[at:]]


def remove_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (from, to of the maximal removed runs), kept (bytes) for each row.

    Texts are judged as UTF-8 bytes, null as empty; matches never cross documents; a repeated row counts
    as another document. Texts under ``length`` bytes lose nothing. Other columns are not read; an
    empty table gives no rows. ``gram``: a power of two, at most ``length``; runs hold at most
    256 stretches, so ``length`` is at most 255 above it."""
    if length - gram + 1 > 256 or gram > length or gram & gram - 1:
        raise ValueError("gram: a power of two, at most length and at least length - 255")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), common.whole_text(text)).alias("rid"),
                      F.shiftrightunsigned(common.text_mark(text), 40).alias("mark"), F.encode(common.whole_text(text), "utf-8").alias("bytes"))
    spans = duplicate_spans(src.select("rid", "mark", "bytes"), length, gram, shard_runs)
    joined = src.join(spans, ["rid", "mark"], "left").select("doc_id", "bytes", "spans")
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    out = T.StructType([common.field(src, "doc_id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gone = joined_spans(len(data), [(s["from"], s["to"]) for s in mine or ()])
            rows.append((len(data), sum(b - a for a, b in gone), [{"from": a, "to": b} for a, b in gone], b"".join(kept_parts(data, gone))))
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], out.names)

    return common.map_arrow(joined, cut, out)
