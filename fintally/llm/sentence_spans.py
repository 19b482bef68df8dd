"""Substring duplicates by sliding spans of sentences.

Every run of several consecutive sentences is hashed; runs are joined on the hash over all documents;
sentences that any repeated run but the first covers are removed. A run starts at every sentence and is
the shortest one with at least ``min_sentences`` sentences and ``min_words`` words, so runs of very
short sentences don't meet by chance and passages of any longer length are covered by their runs. The hash has
88 bits, and equal runs have equal numbers of sentences: of 10^13 different runs (100 TB of text) one pair that shares
both is not expected.

Long sentences are cut further, at words that only the few words around them choose, so that the copies
of a passage are cut alike whatever stands before and behind them. The parts count as sentences.
"""
from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

MIN_SENTENCES, MIN_WORDS = 2, 16
#: White space ends a sentence behind its final mark (and closing quotes), at a line end, and before a
#: capitalised word: a passage pasted into the middle of a sentence starts with one.
FINAL, CLOSING, SMALL, CAPITAL = ".!?…。！？", "\"'”’»)\\]", "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
BOUNDARY = re.compile(rf"[ \t\n\r\f\v\u00a0\u2028](?:(?<=[{FINAL}].)|(?<=[\n\u2028])|(?<=[{FINAL}][{CLOSING}].)|(?:(?<=[{SMALL}].)|(?<=[{SMALL}][,;:].))(?=[{CAPITAL}][{SMALL}]))", re.S)


#: A wide final mark ends a sentence without white space, too.
WIDE = re.compile("[。！？]+[」』”’）】》〉\"'»)\\]]*(?=\\S)")
#: Han and kana are written without spaces: each character counts as a word.
UNSPACED = re.compile("[\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: A sentence of more than LONG words is cut at the words of smallest hash of any WINDOW words.
LONG, WINDOW = 12, 8
SPACED, WHITE, MARK, ALONE = range(4)
#: A run's hash: the first 88 bits of 128, 64 of them as ``h``; the others are the low bits of ``g``, below the run's
#: number of sentences. Both columns travel through two exchanges, so they are as narrow as the size of a corpus allows.
HASH, LOW_BITS = struct.Struct("<qI"), 24


@functools.cache
def char_kinds() -> np.ndarray:
    """By code point: white space, a mark that goes with the word before it, or a word of its own."""
    kinds = np.zeros(0x40001, np.uint8)
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = WHITE
    for a, b in ((0x3001, 0x3040), (0xFF01, 0xFF10), (0xFF1A, 0xFF21), (0xFF61, 0xFF66)):
        kinds[a:b] = MARK
    for a, b in re.findall(r"(.)-(.)", UNSPACED.pattern):
        kinds[ord(a):ord(b) + 1] = ALONE
    return kinds


def cut_long(text: str, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bounds with long sentences cut. Any WINDOW words in a row hold the start of a sentence or one
    of smallest hash (the first of equals): both are places, and the window alone decides."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = char_kinds()[np.minimum(codes, 0x40000)]
    before = np.concatenate(([WHITE], kinds[:-1]))
    starts = np.flatnonzero((kinds == ALONE) | ((kinds != WHITE) & (before == WHITE)) | ((kinds == SPACED) & (before >= MARK)))
    begin, end = np.array(bounds).T
    first = np.searchsorted(starts, begin)
    long = np.searchsorted(starts, end) - first > LONG
    if not long.any():
        return bounds
    mixed = codes * np.uint32(0x9E3779B1)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
    mixed[kinds == WHITE] = 0
    h = np.add.reduceat(mixed, starts, dtype=np.uint32) * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(16))).astype(np.uint64)
    h[first[first < len(starts)]] = 0
    least = h << np.uint64(32) | np.arange(len(starts), dtype=np.uint64)
    for step in (1, 2, 4):  # smallest of 2, 4, then WINDOW words
        least = np.minimum(least[:-step], least[step:])
    chosen = np.zeros(len(starts), bool)
    chosen[least & np.uint64(0xFFFFFFFF)] = True
    chosen[first[first < len(starts)]] = False
    places = np.flatnonzero(chosen)
    places = starts[places[long[np.searchsorted(first, places, "right") - 1]]]
    return list(zip(np.sort(np.concatenate((begin, places))).tolist(), np.sort(np.concatenate((end, places))).tolist()))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence, or part of a long one, that holds a word."""
    marks = [m.span() for m in BOUNDARY.finditer(text)]
    if not text.isascii():
        marks = sorted(marks + [(m.end(), m.end()) for m in WIDE.finditer(text)])
    out, at = [], 0
    for stop, behind in marks:
        if stop > at and not text[at:stop].isspace():
            out.append((at, stop))
        at = behind
    if text[at:].strip():
        out.append((at, len(text)))
    return cut_long(text, out) if out else out


def runs(text: str, min_sentences: int, min_words: int) -> list[tuple[int, int, int]]:
    """(first sentence, h, g) of the run that starts at each sentence, where there is one."""
    words = [text[a:b].split() for a, b in sentences(text)]
    plain = [" ".join(w) for w in words]
    sizes = [len(w) for w in words]
    if not text.isascii() and UNSPACED.search(text):
        sizes = [max(n, len(UNSPACED.findall(p))) for n, p in zip(sizes, plain)]
    out, end, held = [], 0, 0
    for i in range(len(words)):
        end = max(end, i)
        while end < len(words) and (end - i < min_sentences or held < min_words):
            held += sizes[end]
            end += 1
        if end - i < min_sentences or held < min_words:
            break
        h, low = HASH.unpack_from(xxhash.xxh3_128_digest("\n".join(plain[i:end])))
        out.append((i, h, (end - i) << LOW_BITS | low & (1 << LOW_BITS) - 1))
        held -= sizes[i]
    return out


def run_rows(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """h, g (hash and number of sentences), doc_id, mark and first sentence of every run."""
    out = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), common.field(docs, "doc_id"), T.StructField("mark", T.LongType()),
                        T.StructField("first", T.IntegerType())])

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = [], []
        for i, text in enumerate(batch.column(2)):
            mine = runs(text.as_py(), min_sentences, min_words)
            found += mine
            owner += [i] * len(mine)
        if not found:
            return None
        first, h, g = zip(*found)
        at = pa.array(owner, pa.int32())
        return pa.record_batch([pa.array(h, pa.int64()), pa.array(g, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32())], out.names)

    return common.map_arrow(docs.select("doc_id", "mark", "text"), emit, out)


def repeated_runs(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """doc_id, mark, spans (first sentence << 32 | sentences): the runs of each document that stood earlier.
    The first of equal runs is the one with the smallest doc_id, mark and place."""
    rows = common.written(run_rows(docs, min_sentences, min_words), "places")  # read twice, cut once
    place = F.struct("doc_id", "mark", "first")
    first = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("origin")).where("times > 1").select("h", "g", "origin")
    first = common.written(first, "runs")  # as a table, so that the join can split the rows of a frequent run
    later = rows.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("origin")))
    return later.groupBy("doc_id", "mark").agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.shiftright("g", LOW_BITS))).alias("spans"))


def kept_text(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences of the spans (with the white space behind them), and the number
    of sentences removed."""
    if not spans:
        return text, 0
    bounds = sentences(text)
    gone = np.zeros(len(bounds) + 1, np.int32)
    for first, n in spans:
        gone[first] += 1
        gone[min(first + n, len(bounds))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    parts, at = [], 0
    for i, (a, _) in enumerate(bounds):
        stop = bounds[i + 1][0] if i + 1 < len(bounds) else len(text)
        if gone[i]:
            parts.append(text[at:a])
            at = stop
    parts.append(text[at:])
    return "".join(parts), int(gone.sum())


def marked(src: DataFrame) -> DataFrame:
    """doc_id, mark, text: the mark tells the different texts of one doc_id apart; a doc_id with a single text has 0, which
    takes no room in the runs."""
    marks = src.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b")
    several = common.written(marks.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__several")), "several")  # its size is known before the join
    joined = src.join(several, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", F.when(F.col("__several"), F.col("mark")).otherwise(F.lit(0).cast("long")).alias("mark"), "text")


def remove_repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                          min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed (sentences), kept_text for each row.

    Null text is empty, and nothing of it is removed. Rows alike in doc_id and text count as one
    document and get the same result; of equal runs the one of the smallest doc_id (null first), then
    the earliest, stays. Other columns are not read; an empty table gives no rows."""
    src = marked(docs.select(F.col(doc_id).alias("doc_id"), common.text_mark(text).alias("mark"), common.whole_text(text).alias("text")))
    found = repeated_runs(src, min_sentences, min_words).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "spans")
    joined = src.join(found, (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "spans")
    out = T.StructType([common.field(src, "doc_id"), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [kept_text(t, [(s >> 32, s & 0xFFFFFFFF) for s in spans or ()]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        kept, removed = zip(*rows)
        return pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], out.names)

    return common.map_arrow(joined, cut, out)
