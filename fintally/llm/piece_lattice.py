"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words that no piece can cross. Every distinct word is encoded once: its substrings of
bounded length are exploded and equi-joined to the piece table, the edges found are grouped by word,
and a higher-order fold finds the path: for a unigram model Viterbi (largest sum of scores), for a
BPE model the merges in order of score, which is what such a model's own encoder does. Characters without
a piece become byte pieces. Words are then put back in place: frequent ones from a dictionary of bounded size
that every task holds, the rest by a join. The ids of whole documents, in place order, are decoded.
"""
from __future__ import annotations

import contextlib
import functools
import heapq
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common, piece_model
from fintally.llm.piece_model import SPACE

FOLD_CHARS = 48  # longer words are merged with a heap: the fold takes quadratic time
DICTIONARY = 1 << 19  # words in the broadcast dictionary, at most: under 100 MB
DICTIONARY_ROWS = 50_000  # about as many documents are counted to choose the dictionary; all other words are joined
DIGEST = (1 << 32) - 1
WORDS_A_TASK = 20_000  # a word has some dozens of edges; a task holds those of this many
HASHED_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
NO_PIECE = (1 << 20) - 1  # in place of an id
TIED = 20  # strings that are looked for in each word, at most


class Pieces(NamedTuple):
    rows: list[tuple[int, str, float, str]]  # id, piece, score, its bytes in hex
    byte0: int  # id of the piece of byte 0
    longest: int
    by_script: bool  # no piece joins letters and other characters

    def ranks(self) -> dict[str, int]:
        """The pieces' ranks by score, the largest first."""
        return {p: k for k, (_, p, _, _) in enumerate(sorted((r for r in self.rows if r[1] is not None), key=lambda r: -r[2]))}


def letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@functools.lru_cache(maxsize=2)
def load_pieces(model: bytes) -> Pieces:
    sp = piece_model.processor(model)
    if not piece_model.splits_at_spaces(sp):
        raise ValueError("the model's pieces cross spaces, or it changes texts")
    rows, plain, byte0 = [], [], None
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte0 = i if byte0 is None else byte0
            rows.append((i, None, None, f"{i - byte0:02X}"))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rows.append((i, piece, float(sp.get_score(i)), piece.encode().hex().upper()))
            plain.append(piece)
    if byte0 is None:
        raise ValueError("the model has no byte pieces")
    mixed = any(letter(a) != letter(b) for p in plain for s in [p.lstrip(SPACE)] for a, b in zip(s, s[1:]))
    return Pieces(rows, byte0, max(map(len, plain)), not mixed)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """id, piece (null for byte pieces), score, hex: as many rows as the model has pieces."""
    return spark.createDataFrame(pa.table({k: pa.array(c, t) for k, c, t in zip(
        ("id", "piece", "score", "hex"), zip(*pieces.rows), (pa.int32(), pa.string(), pa.float64(), pa.string()))}))


@functools.lru_cache(maxsize=2)
def merged_in_order(model: bytes) -> list[str] | None:
    """Strings without which the merges of a word come in descending order of score, so that its edges need to be
    tried only once, in that order; null if there are none or too many such strings. They are the pieces whose scores
    are not their own. Without them it is so if every piece, as a word, is merged whole by merges of larger
    scores and itself at last: a merge that offered a better piece would lie inside that piece, whose merges
    all have larger scores."""
    pieces = load_pieces(model)
    ranks = pieces.ranks()
    scores = [s for _, p, s, _ in pieces.rows if p is not None and len(p) > 1]
    twice = {s for s, n in Counter(scores).items() if n > 1}
    tied = sorted({p for _, p, s, _ in pieces.rows if p is not None and len(p) > 1 and s in twice}, key=len)
    least: list[str] = []
    for p in tied:
        if not any(x in p for x in least):
            least.append(p)
    if len(least) > TIED:
        return None
    for piece, rank in ranks.items():
        symbols, last = list(piece), -1
        while len(symbols) > 1 and not any(x in piece for x in least):
            best, i = min((ranks.get(symbols[i] + symbols[i + 1], rank + 1), i) for i in range(len(symbols) - 1))
            if best > rank or best < last:
                return None
            symbols[i:i + 2], last = [symbols[i] + symbols[i + 1]], best
    return least


def words_of(text: Column, pieces: Pieces) -> Column:
    """The words of a text: a stretch of spaces with the letters, or the other characters, behind it."""
    parts = rf"[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}{SPACE}]+" if pieces.by_script else f"[^{SPACE}]+"
    whole = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(whole, F.lit(f"{SPACE}*(?:{parts})|{SPACE}+"), F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def merge_path(n: Column, scores: Column) -> Column:
    """Bounds of the symbols of a word of ``n`` characters after all merges: each step joins the two
    neighbours whose joint piece has the largest score, the leftmost of equals. ``scores``: by
    from * 64 + to. The state is one struct per symbol, (score of joining it with the next one or
    null, minus its start): its largest element is the next merge, and a merge changes two elements."""
    def symbol(start: Column, to: Column) -> Column:
        return F.struct(F.try_element_at(scores, start * 64 + to).alias("joined"), (-start).alias("start"))

    def bound(state: Column, i: Column) -> Column:  # start of symbol i, or the end of the word
        return F.coalesce(-F.get(state, i)["start"], n)

    def step(state: Column, _: Column) -> Column:
        best = F.array_max(state)
        return let(F.when(best["joined"].isNotNull(), F.array_position(state, best).cast("int")), lambda at: F.when(at.isNull(), state).otherwise(F.concat(
            F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))),
            F.when(at > 1, F.array(symbol(bound(state, at - 2), bound(state, at + 1)))).otherwise(F.slice(state, F.lit(1), F.lit(0))),
            F.array(symbol(bound(state, at - 1), F.when(at + 1 < F.size(state), bound(state, at + 2)))),
            F.slice(state, at + 2, F.size(state)))))
    first = F.transform(F.sequence(F.lit(0), n - 1), lambda i: symbol(i, F.when(i + 2 <= n, i + 2)))
    return let(F.aggregate(F.sequence(F.lit(1), n), first, step), lambda state: F.concat(F.transform(state, lambda x: -x["start"]), F.array(n)))


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def merged_bits(n: Column, edges: Column) -> Column:
    """merge_path where merges come in order of score: the bounds of the symbols as bits of a long. ``edges``
    are those of several characters, the best first, as rank << 32 | id << 12 | from << 6 | to. An edge merges if its
    ends are bounds with one other bound between them, which then goes."""
    def step(bounds: Column, edge: Column) -> Column:
        first, last = bit(F.shiftright(edge, 6).bitwiseAND(63)), bit(edge.bitwiseAND(63))
        between = bounds.bitwiseAND(last - first * 2)
        joined = (F.bit_count(between) == 1) & (bounds.bitwiseAND(first) != 0) & (bounds.bitwiseAND(last) != 0)
        return F.when(joined, bounds - between).otherwise(bounds)
    return F.aggregate(edges, bit(n + 1) - 1, step)


def viterbi_path(n: Column, scores: Column, longest: int, unknown: float) -> Column:
    """Bounds of the segmentation with the largest sum of scores (the longer last piece of equals); a
    character without a piece costs ``unknown``."""
    def step(state: Column, to: Column) -> Column:
        first = F.greatest(F.lit(0), to - longest)
        ways = F.transform(F.sequence(first, to - 1), lambda start: F.struct(
            (F.get(state, start)["total"] + F.coalesce(F.try_element_at(scores, start * 64 + to), F.when(start == to - 1, F.lit(unknown)))).alias("total"), (-start).alias("start")))
        return let(F.array_max(ways), lambda best: F.concat(state, F.array(F.struct(best["total"].alias("total"), (-best["start"]).alias("start")))))
    none = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("start")))
    best = F.aggregate(F.sequence(F.lit(1), n), none, step)
    back = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda bounds, _: F.when(bounds[0] > 0, F.concat(F.array(F.get(best, bounds[0])["start"]), bounds)).otherwise(bounds))
    return back


def edges_of(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """The edges (s, l and the columns of ``table``; nulls for a character without a piece) of ``words`` of at most
    FOLD_CHARS characters: substrings joined to the piece table."""
    rest = [c for c in words.columns if c != "word"]
    n = F.length("word")
    start = F.explode(F.sequence(F.lit(0), n - 1)).alias("s")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("l")
    edges = words.where(n <= FOLD_CHARS).select("word", *rest, start).select("word", *rest, "s", size).withColumn("piece", F.substring("word", F.col("s") + 1, F.col("l")))
    key = next(c for c in table.columns if c != "piece")
    return edges.join(F.broadcast(table), "piece", "left").where(F.col(key).isNotNull() | (F.col("l") == 1))


def byte_ids(char: Column, byte0: int) -> Column:
    return let(F.hex(F.encode(char, "utf-8")), lambda code: F.transform(
        F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte0))


def encode_in_order(words: DataFrame, spark: SparkSession, model: bytes) -> DataFrame:
    """``encode_folded`` for words whose merges come in order of score."""
    pieces = load_pieces(model)
    rest = [c for c in words.columns if c != "word"]
    ranks = pieces.ranks()
    known = [(p, ranks[p] << 32 | i << 12) for i, p, _, _ in pieces.rows if p is not None]
    table = spark.createDataFrame(pa.table({"piece": pa.array([p for p, _ in known]), "code": pa.array([c for _, c in known], pa.int64())}))
    code = F.coalesce("code", F.lit(len(ranks) << 32 | NO_PIECE << 12)) + F.col("s") * 64 + F.col("s") + F.col("l")
    lattice = edges_of(words, table, pieces.longest).groupBy("word", *rest).agg(F.collect_list(code).alias("edges"))
    several = F.sort_array(F.filter("edges", lambda e: e.bitwiseAND(63) - F.shiftright(e, 6).bitwiseAND(63) > 1))

    def kept(bounds: Column) -> Column:
        def symbol(edge: Column) -> Column:
            first, last = bit(F.shiftright(edge, 6).bitwiseAND(63)), bit(edge.bitwiseAND(63))
            return bounds.bitwiseAND(last * 2 - first) == first + last
        return F.sort_array(F.transform(F.filter("edges", symbol), lambda edge: F.shiftleft(
            F.shiftright(edge, 6).bitwiseAND(63), 20) + F.shiftright(edge, 12).bitwiseAND(NO_PIECE)))

    def ids(symbols: Column) -> Column:
        at = lambda x: F.shiftright(x, 20).cast("int")
        piece = lambda x: x.bitwiseAND(NO_PIECE).cast("int")
        spelled = F.flatten(F.transform(symbols, lambda x: F.when(piece(x) == NO_PIECE, byte_ids(
            F.substring("word", at(x) + 1, F.lit(1)), pieces.byte0)).otherwise(F.array(piece(x)))))
        return F.when(F.exists(symbols, lambda x: piece(x) == NO_PIECE), spelled).otherwise(F.transform(symbols, piece))

    # each step's result is bound once: a column of its own would be computed again for every edge
    return lattice.select("word", *rest, let(let(merged_bits(F.length("word"), several), kept), ids).alias("ids"))


def encode_folded(words: DataFrame, spark: SparkSession, model: bytes, unigram: bool = False) -> DataFrame:
    """``words`` (distinct column word, any other columns) of at most FOLD_CHARS characters with ids (array
    of int). The lattice is grouped where the words are, if they are partitioned by word."""
    words = words.where(F.length("word") <= FOLD_CHARS)
    tied = None if unigram else merged_in_order(model)
    if tied is None:
        return encode_any(words, spark, model, unigram)
    other = F.lit(False)
    for p in tied:
        other = other | F.contains("word", F.lit(p))
    return encode_in_order(words.where(~other), spark, model).unionByName(encode_any(words.where(other), spark, model))


def encode_any(words: DataFrame, spark: SparkSession, model: bytes, unigram: bool = False) -> DataFrame:
    """``encode_folded`` for any words: merges in any order, or Viterbi."""
    pieces = load_pieces(model)
    rest = [c for c in words.columns if c != "word"]
    table = piece_table(spark, pieces).where("piece is not null").select("id", "piece", "score")  # bounded by the model
    n = F.length("word")
    edges = edges_of(words, table, pieces.longest)
    edge = F.struct((F.col("s") * 64 + F.col("s") + F.col("l")).alias("at"), F.col("id"), F.col("score").cast("float").alias("score"))
    lattice = edges.groupBy("word", *rest).agg(F.collect_list(edge).alias("edges"))
    scores = F.map_from_entries(F.transform(F.filter("edges", lambda e: e["score"].isNotNull()), lambda e: F.struct(e["at"], e["score"])))
    lattice = lattice.select("word", *rest, n.alias("n"), scores.alias("scores"), F.map_from_entries(F.transform("edges", lambda e: F.struct(e["at"], e["id"]))).alias("found"))
    lowest = min(s for _, p, s, _ in pieces.rows if p is not None)
    path = viterbi_path(F.col("n"), F.col("scores"), pieces.longest, lowest - 10) if unigram else merge_path(F.col("n"), F.col("scores"))

    def ids(x: Column, i: Column) -> Column:
        """The ids of one symbol: its piece, or the pieces of its bytes."""
        to = F.get("bounds", i + 1)
        return let(F.try_element_at("found", x * 64 + to), lambda piece: F.when(piece.isNotNull(), F.array(piece)).otherwise(
            byte_ids(F.substring("word", x + 1, to - x), pieces.byte0)))

    return lattice.select("word", *rest, "found", path.alias("bounds")).select(
        "word", *rest, F.flatten(F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), ids)).alias("ids"))


def encode_long(words: DataFrame, model: bytes, unigram: bool = False) -> DataFrame:
    """``words`` of more than FOLD_CHARS characters with ids, by the same rule with a heap."""
    pieces = load_pieces(model)
    src = words.where(F.length("word") > FOLD_CHARS)
    out = T.StructType([*src.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    at = src.columns.index("word")

    def run(batch: pa.RecordBatch, table: dict) -> pa.RecordBatch:
        paths = [(viterbi_word if unigram else merge_word)(w, table, pieces) for w in batch.column(at).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(paths, pa.list_(pa.int32()))], out.names)

    return common.map_arrow(src, run, out, lambda: {p: (i, s) for i, p, s, _ in load_pieces(model).rows if p is not None})


def encode_words(words: DataFrame, spark: SparkSession, model: bytes, unigram: bool = False) -> DataFrame:
    """``words`` (distinct column word, any other columns) with ids (array of int)."""
    return encode_folded(words, spark, model, unigram).unionByName(encode_long(words, model, unigram))


def ids_of(symbols: list[str], table: dict, pieces: Pieces) -> list[int]:
    out: list[int] = []
    for s in symbols:
        out += [table[s][0]] if s in table else [pieces.byte0 + b for b in s.encode()]
    return out


def merge_word(word: str, table: dict, pieces: Pieces) -> list[int]:
    """merge_path for long words, with a heap of candidate merges."""
    after, before, end = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(word)
        if i >= 0 and j < len(word) and end[j] - i <= pieces.longest and (found := table.get(word[i:end[j]])):
            heapq.heappush(heap, (-found[1], i, end[i], end[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] != middle or j >= len(word) or j != middle or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], -1
        if after[i] < len(word):
            before[after[i]] = i
        offer(i)
        offer(before[i])
    symbols, i = [], 0
    while i < len(word):
        symbols.append(word[i:end[i]])
        i = end[i]
    return ids_of(symbols, table, pieces)


def viterbi_word(word: str, table: dict, pieces: Pieces) -> list[int]:
    """viterbi_path for long words."""
    unknown = min(s for _, s in table.values()) - 10
    best = [(0.0, 0)]
    for to in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, to - pieces.longest), to):
            score = table[word[start:to]][1] if word[start:to] in table else unknown if start == to - 1 else None
            if score is not None:
                ways.append((best[start][0] + score, -start))
        total, start = max(ways)
        best.append((total, -start))
    symbols, to = [], len(word)
    while to:
        symbols.append(word[best[to][1]:to])
        to = best[to][1]
    return ids_of(symbols[::-1], table, pieces)


def decode(encoded: DataFrame, model: bytes, keep_spaces: bool = False) -> DataFrame:
    """``encoded`` with the column text in place of ids: the text of each row's ids. Ids without a piece
    (and null) stand for nothing; no ids give an empty text. Map-only."""
    at = encoded.columns.index("ids")
    out = T.StructType([f if f.name != "ids" else T.StructField("text", T.StringType()) for f in encoded.schema])

    def table() -> pa.Array:
        """The bytes of every id; nothing for the last."""
        parts = {i: bytes.fromhex(code) for i, _, _, code in load_pieces(model).rows}
        if not keep_spaces:
            parts = {i: b.replace(SPACE.encode(), b" ") for i, b in parts.items()}
        return pa.array([parts.get(i, b"") for i in range(max(parts) + 2)], pa.large_binary())

    def run(batch: pa.RecordBatch, parts: pa.Array) -> pa.RecordBatch:
        ids = batch.column(at)
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        taken = parts.take(pa.array(np.where((flat >= 0) & (flat < len(parts)), flat, len(parts) - 1), pa.int64()))
        # the taken parts lie one behind the other: a row's text is the stretch of its ids
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[np.concatenate([[0], np.cumsum(size)])] if len(taken) else np.zeros(len(size) + 1, np.int64)
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if not keep_spaces:
            texts = [t.removeprefix(" ") for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.record_batch(columns, out.names)

    return common.map_arrow(encoded, run, out, table)


def cut_documents(docs: DataFrame, text: str, doc_id: str, pieces: Pieces) -> DataFrame:
    """key (doc_id, mark), words (array, empty for an empty text), sent (digest of the text), meant (of the text with spaces
    for U+2581, null if it is the same) for each row. The key is compared as a whole: a null doc_id is like another."""
    whole = common.whole_text(text)
    plain = F.when(F.contains(whole, F.lit(SPACE)), F.unhex(F.sha2(F.replace(whole, F.lit(SPACE), F.lit(" ")), 256)))
    return docs.select(F.struct(F.col(doc_id).alias("doc_id"), common.text_mark(text).alias("mark")).alias("key"), words_of(whole, pieces).alias("words"),
                       F.unhex(F.sha2(whole, 256)).alias("sent"), plain.alias("meant"))


@contextlib.contextmanager
def hashed_groups(spark: SparkSession):
    """Jobs in here group the edges of a task's words without a sort."""
    number = spark.conf.get(HASHED_GROUPS)
    spark.conf.set(HASHED_GROUPS, str(max(int(number), 8 * WORDS_A_TASK)))
    try:
        yield
    finally:
        spark.conf.set(HASHED_GROUPS, number)


def frequent_from(words: DataFrame, most: int) -> int:
    """The least ``times`` such that at most ``most`` words occur as often. Times are counted in at most
    64 * 16 steps, so the driver sees as few rows at any size."""
    step = F.floor(F.log2("times") * 16)
    taken, least = 0, None
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("times")).orderBy(F.desc("step")).collect():
        taken += r["n"]
        if taken > most:
            break
        least = r["times"]
    return least if least is not None else (1 << 62)


def frequent_words(cut: DataFrame, rows: int, model: bytes, most: int, unigram: bool) -> pa.Table:
    """word, ids, h (hash of the ids) of at most ``most`` words that occur twice or more in about DICTIONARY_ROWS of the
    ``rows`` documents, chosen by hash; the most frequent first. Only speed depends on the choice: all other words are joined."""
    spark, share = cut.sparkSession, max(1, -(-rows // DICTIONARY_ROWS))
    some = cut.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
    counted = common.written(some.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "words")
    words = counted.where(F.col("times") >= frequent_from(counted, most))
    with hashed_groups(spark):
        known = common.written(encode_words(words.repartition(max(1, -(-words.count() // WORDS_A_TASK)), "word"), spark, model, unigram), "dictionary")
    return known.select("word", "times", F.col("ids").cast("array<int>").alias("ids"), F.xxhash64("ids").alias("h")).toArrow().sort_by([("times", "descending"), ("word", "ascending")])


class Dictionary:
    """The frequent words, in a task."""

    def __init__(self, data: bytes):
        table = pa.ipc.open_stream(data).read_all()
        self.words, self.ids, self.h = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in map(table.column, ("word", "ids", "h")))

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[list[str]]]:
        """Of a batch of documents' words: their bounds among all words, each word's place in the dictionary, from 1 (0:
        none), where the others are, their numbers in their document and, by document, these words as numbered."""
        flat = words.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
        found = pc.fill_null(pc.index_in(flat, value_set=self.words.cast(flat.type)), -1).to_numpy(zero_copy_only=False) + 1
        others = np.flatnonzero(found == 0)
        numbers, named = [], [{} for _ in range(len(words))]
        for doc, word in zip((np.searchsorted(bounds, others, "right") - 1).tolist(), flat.take(pa.array(others)).to_pylist()):
            numbers.append(named[doc].setdefault(word, len(named[doc])))
        return bounds, found, others, numbers, [list(x) for x in named]


def rare_words(cut: DataFrame, frequent) -> DataFrame:
    """key, rare: the words of each document that are not in the dictionary, once each, in order."""
    src = cut.select("key", "words")
    out = T.StructType([src.schema["key"], T.StructField("rare", T.ArrayType(T.StringType()))])

    def run(batch: pa.RecordBatch, known: Dictionary) -> pa.RecordBatch:
        *_, named = known.places(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(named, pa.list_(pa.string()))], out.names).filter(pa.array([bool(x) for x in named]))

    return common.map_arrow(src, run, out, lambda: Dictionary(frequent.value))


PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def place_marks(places: np.ndarray, h: np.ndarray) -> np.ndarray:
    """xxhash64(place, h) as Spark computes it (int, long; seed 42), its DIGEST bits."""
    p1, p2, p3, p4, p5 = PRIMES

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))
    x = (np.uint64(46) + p5) ^ (places.astype(np.uint64) * p1) if len(places) else np.zeros(0, np.uint64)
    x = mixed(turned(x, 23) * p2 + p3)
    x = (x + p5 + np.uint64(8)) ^ (turned(h.view(np.uint64) * p2, 31) * p1)
    return (mixed(turned(x, 27) * p1 + p4) & np.uint64(DIGEST)).astype(np.int64)


def placed_words(cut: DataFrame, frequent) -> DataFrame:
    """key, sent, meant, n_words, places (of the words in the dictionary, from 1, or 0; three planes of bytes,
    compressed), number (of each 0: the word's number among the document's others) of each row."""
    src = cut.select("key", "sent", "meant", "words")
    out = T.StructType([*src.schema.fields[:3], T.StructField("n_words", T.LongType()), T.StructField("places", T.BinaryType()),
                        T.StructField("number", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch, known: Dictionary) -> pa.RecordBatch:
        bounds, found, others, numbers, _ = known.places(batch.column(3))
        planes = found.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        data = [pa.compress(planes[a:b].T.tobytes(), codec="zstd", asbytes=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        number = pa.ListArray.from_arrays(pa.array(np.searchsorted(others, bounds), pa.int32()), pa.array(numbers, pa.int32()))
        return pa.record_batch([*batch.columns[:3], pa.array(np.diff(bounds), pa.int64()), pa.array(data, pa.binary()), number], out.names)

    return common.map_arrow(src, run, out, lambda: Dictionary(frequent.value))


def filled(placed: DataFrame, frequent) -> DataFrame:
    """key, sent, meant, n_words, digest (sum of the marks of each word's place and ids), ids (array of int, in place
    order) of ``placed_words`` with parts (number, ids of the document's other words)."""
    src = placed.select("key", "sent", "meant", "n_words", "places", "number", *[F.coalesce(c, F.array().cast(t)).alias(a) for c, t, a in (
        (F.col("parts.number"), "array<int>", "numbers"), (F.col("parts.ids"), "array<array<int>>", "part"),
        (F.transform("parts.ids", lambda x: F.xxhash64(x)), "array<bigint>", "h"))])
    out = T.StructType([*src.schema.fields[:4], T.StructField("digest", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch, known: Dictionary) -> pa.RecordBatch:
        n_words = batch.column(3).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        planes = [np.frombuffer(pa.decompress(x.as_buffer(), 3 * n, codec="zstd"), np.uint8).reshape(3, n).astype(np.int64) for x, n in zip(batch.column(4), n_words.tolist())]
        found = np.concatenate([p[0] | p[1] << 8 | p[2] << 16 for p in planes])
        doc_of = np.repeat(np.arange(batch.num_rows), n_words)
        # behind the dictionary's words come the batch's others, by document and number, and one for a word without ids
        parts = pa.concat_arrays([known.ids, batch.column(7).flatten().cast(known.ids.type), pa.array([[]], known.ids.type)])
        h = np.concatenate([known.h.to_numpy(zero_copy_only=False), batch.column(8).flatten().to_numpy(zero_copy_only=False), [0]]).astype(np.int64)

        def keys(docs: np.ndarray, numbers: pa.Array) -> np.ndarray:
            return docs << 32 | numbers.to_numpy(zero_copy_only=False)
        there = keys(np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False)), batch.column(6).flatten())
        order = np.argsort(there)
        asked = keys(doc_of[found == 0], batch.column(5).flatten())
        at = np.searchsorted(there, asked, sorter=order)
        hit = np.full(len(asked), len(parts) - 1)
        here = at < len(there)
        here[here] = there[order[at[here]]] == asked[here]
        hit[here] = len(known.ids) + order[at[here]]
        found = found - 1
        found[found < 0] = hit
        marks = place_marks(np.arange(len(found)) - bounds[doc_of], h[found])
        digest = np.diff(np.concatenate([[0], np.cumsum(np.where(found < len(parts) - 1, marks, 0))])[bounds])
        ids = parts.take(pa.array(found))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])[bounds]
        return pa.record_batch([*batch.columns[:4], pa.array(digest, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.flatten().cast(pa.int32()))], out.names)

    return common.map_arrow(src, run, out, lambda: Dictionary(frequent.value))


def encode_rows(docs: DataFrame, model: bytes, text: str, doc_id: str, dictionary: int, unigram: bool) -> DataFrame:
    """The columns of ``filled`` for each row of ``docs``. Rows alike in doc_id and text share their rare words."""
    spark = docs.sparkSession
    cut = cut_documents(docs, text, doc_id, load_pieces(model))
    known = frequent_words(cut, docs.count(), model, min(dictionary, (1 << 24) - 2), unigram)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as stream:
        stream.write_table(known)
    frequent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    rare = common.written(rare_words(cut, frequent), "rare")
    most = rare.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0)).alias("n")).collect()[0]["n"]
    others = rare.select(F.col("key").alias("of"), F.posexplode("rare").alias("number", "word"))
    tasks, long = max(1, -(-most // WORDS_A_TASK)), F.length("word") > FOLD_CHARS

    def parts_of(some: DataFrame, encode) -> DataFrame:
        dealt = some.repartition(tasks, "word")
        return dealt.join(encode(dealt.select("word").distinct()), "word").select("of", F.struct("number", "ids").alias("part"))
    parts = parts_of(others.where(~long), lambda words: encode_folded(words, spark, model, unigram)).unionByName(
        parts_of(others.where(long), lambda words: encode_long(words, model, unigram)))
    with hashed_groups(spark):
        parts = common.written(parts, "parts")
    parts = parts.groupBy("of").agg(F.collect_list("part").alias("parts"))
    return filled(placed_words(cut, frequent).join(parts, F.col("key") == F.col("of"), "left"), frequent)


def token_digests(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", dictionary: int = DICTIONARY, unigram: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens, token_digest, decoded, verbatim for each row: the number of words and
    tokens, the sum of 32-bit marks of each word's place and ids, whether the document's ids, decoded, give its text
    back (with spaces for U+2581, which stands for a space to the model), and whether they give the very text.

    Texts are compared by their SHA-256. Null text is empty: no tokens, digest 0, decoded and verbatim true. Rows alike
    in doc_id and text get a row each, with equal results; other columns are not read; an empty table gives no rows."""
    ids = encode_rows(docs, model, text, doc_id, dictionary, unigram)
    back = decode(ids.withColumn("n_tokens", F.size("ids").cast("long")), model)
    got = back.withColumn("got", F.unhex(F.sha2("text", 256)))
    return got.select("key.doc_id", "n_words", "n_tokens", F.col("digest").alias("token_digest"), (F.col("got") == F.coalesce("meant", "sent")).alias("decoded"),
                      (F.col("got") == F.col("sent")).alias("verbatim"))


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", dictionary: int = DICTIONARY, unigram: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every document; rows alike in doc_id and text are one document."""
    return encode_rows(docs.select(doc_id, text).distinct(), model, text, doc_id, dictionary, unigram).select("key.doc_id", "ids")
