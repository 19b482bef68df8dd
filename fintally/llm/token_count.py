"""Token counts by the whole-token shortcut.

Offline, the vocabulary strings that encode alone as exactly one token are proved by encoding each of
them. In a text, pre-tokens (a stretch of spaces with the word behind it) that are such strings count
as one token by a dictionary look-up; only the other pre-tokens are merged by the tokenizer, once per
distinct pre-token of a worker.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common, piece_model

RUNS = re.compile(" *[^ ]+| +$")
KNOWN_LIMIT = 300_000  # learned pre-tokens kept by a worker; beyond it they are learned anew


class PieceCounter:
    """Counts tokens of texts as ``SentencePieceProcessor.encode`` would return them."""

    def __init__(self, model: bytes):
        self.sp = piece_model.processor(model)
        self.by_word = piece_model.splits_at_spaces(self.sp)
        self.whole = self.proved() if self.by_word else {}
        self.known = dict(self.whole)

    def proved(self) -> dict[str, int]:
        """The words w for which the library encodes w, with the space before it, as one token."""
        sp = self.sp
        words = [p[1:] for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i)).startswith(piece_model.SPACE)]
        words = [w for w in words if w and piece_model.SPACE not in w]
        return {w: 1 for w, ids in zip(words, sp.encode(words)) if len(ids) == 1}

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Pre-tokens, each without the one space that stands before it (the tokenizer puts one
        before the text)."""
        text = text.replace(piece_model.SPACE, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in RUNS.findall(" " + text)]
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        if len(self.known) > KNOWN_LIMIT + len(self.whole):
            self.known = dict(self.whole)
        split = [self.pretokens(t) for t in texts]
        new = list(set().union(*split) - self.known.keys())
        # a pre-token of spaces alone: "" here is one space
        self.known.update(zip(new, map(len, self.sp.encode(new, num_threads=1))))
        if "" in new:
            self.known[""] = self.lone_space()
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]

    def lone_space(self) -> int:
        """Tokens of one space that ends a text, behind a word."""
        return len(self.sp.encode("a ")) - len(self.sp.encode("a"))


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row (null text: empty, 0 tokens; repeated rows
    are counted each; other columns are not read). Map-only: no shuffle, one pass."""
    src = docs.select(F.col(doc_id).alias("doc_id"), common.whole_text(text).alias("text"))
    out = T.StructType([common.field(src, "doc_id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batch: pa.RecordBatch, counter: PieceCounter) -> pa.RecordBatch:
        parts, step = [], 512
        for at in range(0, batch.num_rows, step):
            parts += counter.counts(batch.column(1).slice(at, step).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(parts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = common.map_arrow(src.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")), count, out, lambda: counter_of(model))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


_counters: dict[bytes, PieceCounter] = {}


def counter_of(model: bytes) -> PieceCounter:
    """One counter per worker process; what it has learned serves later tasks."""
    if model not in _counters:
        _counters.clear()
        _counters[model] = PieceCounter(model)
    return _counters[model]
