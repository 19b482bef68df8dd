"""Priority rules: the first active rule that matches a transaction decides its category.

Rule kinds (patterns compared lower-cased): merchant_contains, merchant_exact,
description_contains, and amount_range "min,max" (inclusive, on |amount|; a pattern that
does not split into two numbers never matches). Order: priority desc, created_at asc, id.

Rules are matched by one path whatever their number: blocks of at most ``RULE_BLOCK`` rules, in rank
order, each broadcast once (packed) and matched with an Aho-Corasick automaton per text column and, for amounts,
a table of elementary intervals with the first rule that holds each. One Python worker a task goes through the blocks
for some rows at a time and has the matcher of one block only; a row that is matched is done. Of rules alike in kind
and pattern the first alone is asked. Transactions pass through as Arrow batches; their columns are not converted.
"""
from __future__ import annotations

import functools
import itertools
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE_BLOCK = 20_000
#: Rows that go through the blocks together.
HELD_ROWS = 500_000


def parse_range(pattern: str):
    """(lo, hi) floats of an amount_range pattern, or None when it is malformed."""
    parts = pattern.lower().split(",")
    if len(parts) != 2:
        return None
    try:
        return float(parts[0]), float(parts[1])
    except ValueError:
        return None


def ordered_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Active rules whose category exists, with their match rank (0 = first tried)."""
    cats = categories.select(F.col("id").alias("category_id"))
    return (rules.filter(F.col("is_active")).join(cats, "category_id")
            .select("id", "rule_type", "pattern", "category_id", "priority", "created_at"))


class Stabbing:
    """The least rank of the ranges (rank, lo, hi) that hold an amount, ends included.

    The sorted ends cut the line into points and gaps between them, each of which every range holds as a whole
    or not at all. Ranges take their points and gaps in order of rank, skipping those that are taken, so the
    table is built in about linear time; an amount is one binary search, whatever the number of ranges."""

    def __init__(self, ranges: list[tuple[int, float, float]], none: int):
        ranges = [r for r in ranges if r[1] <= r[2]]  # also leaves out NaN
        self.ends = np.unique(np.array([x for _, lo, hi in ranges for x in (lo, hi)], float))
        # place 2 i + 1 is end i, place 2 i the gap below it; the last gap is held by no range
        best = [none] * (2 * len(self.ends) + 1)
        free = list(range(len(best) + 1))  # the next place that is not taken, from each place on

        def next_free(place: int) -> int:
            while free[place] != place:
                free[place] = place = free[free[place]]
            return place

        for rank, lo, hi in sorted(ranges):
            first, last = (2 * int(i) + 1 for i in np.searchsorted(self.ends, (lo, hi)))
            while (first := next_free(first)) <= last:
                best[first], free[first] = rank, first + 1
        self.best = np.array(best)

    def ranks(self, amounts: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.full(len(amounts), self.best[0])
        at = np.searchsorted(self.ends, amounts)
        return self.best[2 * at + (self.ends[np.minimum(at, len(self.ends) - 1)] == amounts)]


class RuleBlock:
    """Matches texts and amounts against rules (id, rule_type, pattern, category_id) in rank order."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick

        self.rules = rules
        self.exact: dict[str, int] = {}
        self.always: dict[str, int] = {}  # rank of an empty pattern: every text holds it
        ranges: list[tuple[int, float, float]] = []
        words: dict[str, dict[str, int]] = {"merchant_contains": {}, "description_contains": {}}
        for rank, (_, kind, pattern, _) in enumerate(rules):
            p = pattern.lower()
            if kind in words:
                (words[kind] if p else self.always).setdefault(p or kind, rank)
            elif kind == "merchant_exact":
                self.exact.setdefault(p, rank)
            elif kind == "amount_range" and (rng := parse_range(pattern)):
                ranges.append((rank, *rng))
        self.ranges = Stabbing(ranges, len(rules))
        self.words = {}
        for kind, ranks in words.items():
            automaton = ahocorasick.Automaton()
            for p, rank in ranks.items():
                automaton.add_word(p, rank)
            if ranks:
                automaton.make_automaton()
                self.words[kind] = automaton

    def contained(self, kind: str, text: str) -> int:
        best = self.always.get(kind, len(self.rules))
        if kind in self.words and text:
            for _, rank in self.words[kind].iter(text):
                best = min(best, rank)
        return best

    def merchant_rank(self, text: str | None) -> int:
        none = len(self.rules)
        return none if text is None else min(self.contained("merchant_contains", text), self.exact.get(text, none))

    def description_rank(self, text: str) -> int:
        return self.contained("description_contains", text)


def _blocks(rules: DataFrame, categories: DataFrame):
    """The ordered rules, at most RULE_BLOCK of them on the driver at a time."""
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    first = F.row_number().over(Window.partitionBy("rule_type", "pattern").orderBy(*order))
    ordered = ordered_rules(rules, categories).withColumn("_same", first).where("_same = 1").orderBy(*order)
    rows = ((r["id"], r["rule_type"], r["pattern"], r["category_id"]) for r in ordered.toLocalIterator())
    while block := list(itertools.islice(rows, RULE_BLOCK)):
        yield block


def _held(batches):
    """Lists of batches, each of about HELD_ROWS rows."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD_ROWS:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _coded(batches: list[pa.RecordBatch], at: int) -> tuple[list, np.ndarray]:
    """The distinct texts of a column (null is one) and each row's number in them."""
    coded = pa.chunked_array([b.column(at) for b in batches]).combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def first_matches(batches: list[pa.RecordBatch], n: int, matchers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Category, rule and whether there is one, for each row; lower-cased merchant and description and the amount
    are columns ``n`` + 2 to ``n`` + 4. ``matchers`` gives the blocks in order."""
    merchants, m = _coded(batches, n + 2)
    descriptions, d = _coded(batches, n + 3)
    amounts = np.concatenate([b.column(n + 4).to_numpy(zero_copy_only=False).astype(float) for b in batches])
    category, rule, open_rows = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.arange(len(m))

    def ranks(texts: list, codes: np.ndarray, rank) -> np.ndarray:
        used, back = np.unique(codes, return_inverse=True)
        return np.array([rank(texts[i]) for i in used], np.int64)[back]

    for matcher in matchers:
        if not len(open_rows):
            break
        best = np.minimum(ranks(merchants, m[open_rows], matcher.merchant_rank), ranks(descriptions, d[open_rows], matcher.description_rank))
        best = np.minimum(best, matcher.ranges.ranks(amounts[open_rows]))
        hit = best < len(matcher.rules)
        rows, at = open_rows[hit], best[hit]
        category[rows] = np.array([r[3] for r in matcher.rules], np.int64)[at]
        rule[rows] = np.array([r[0] for r in matcher.rules], np.int64)[at]
        open_rows = open_rows[~hit]
    known = np.ones(len(m), bool)
    known[open_rows] = False
    return category, rule, known


def rules_match(txns: DataFrame, rules: DataFrame, categories: DataFrame,
                out: str = "rule_category_id") -> DataFrame:
    """Add ``out`` (matched category id or NULL) and ``rule_id`` to every transaction. A missing
    merchant matches no merchant rule; a missing description counts as empty text."""
    names = txns.columns
    df = txns.select("*", F.lit(None).cast("long").alias(out), F.lit(None).cast("long").alias("rule_id"),
                     F.lower("merchant").alias("_rule_m"), F.lower(F.coalesce("description", F.lit(""))).alias("_rule_d"),
                     F.abs("amount").cast("double").alias("_rule_a"))
    n = len(names)
    shared = [txns.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(block))) for block in _blocks(rules, categories)]

    def match(batches):
        made = functools.lru_cache(maxsize=1)(lambda i: RuleBlock(pickle.loads(zlib.decompress(shared[i].value))))
        for held in _held(batches):
            category, rule, known = first_matches(held, n, map(made, range(len(shared))))
            at = 0
            for b in held:
                part = slice(at, at + b.num_rows)
                columns = list(b.columns)
                for place, values in ((n, category), (n + 1, rule)):
                    columns[place] = pa.array(values[part], pa.int64(), mask=~known[part])
                yield pa.record_batch(columns, schema=b.schema)
                at += b.num_rows

    if shared:
        df = df.mapInArrow(match, df.schema)
    return df.drop("_rule_m", "_rule_d", "_rule_a")


def rules_apply_uncategorized(txns: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Fill NULL categories from the first matching rule; ``rule_applied`` marks changed rows."""
    matched = rules_match(txns, rules, categories)
    applied = F.col("category_id").isNull() & F.col("rule_category_id").isNotNull() & (F.col("rule_category_id") != 0)
    return (matched.withColumn("rule_applied", applied)
            .withColumn("category_id", F.when(applied, F.col("rule_category_id")).otherwise(F.col("category_id")))
            .drop("rule_category_id", "rule_id"))
