"""Licence scan with ordered signature rules.

One pass of an Aho-Corasick automaton over a text finds which rule keywords it holds; only the rules
of those keywords are tried. Detections are ranked by the rule's priority, then length, then rank; one
that lies inside a detection of higher rank is suppressed, so a versioned licence hides the
bare name inside it. Base phrases are counted apart from that and are never suppressed.
"""
from __future__ import annotations

import bisect
import functools
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common
from fintally.llm.license_rules import KINDS, WORD, base_rules, identifiers, rules

WORDS = re.compile(WORD + "+")
TAG = re.compile(r"spdx-license-identifier:\s*")
#: The next part of an SPDX expression; inside parentheses it may go on in the next (comment) line.
PART, INNER = (re.compile(gap + r"([()]|[\w.+:-]+)") for gap in (r"[^\S\n]*", r"\s*(?:[#*/;]+\s*)?"))


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    kind: str
    rank: int


class Scanner:
    def __init__(self):
        import ahocorasick
        self.rules = [(r, re.compile(r.regex)) for r in rules()]
        self.base = [(r, re.compile(r.regex)) for r in base_rules()]
        self.keywords = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules + self.base):
            by_key.setdefault(max(r.keyword.split(), key=len), []).append(i)  # its words may stand on two lines
        for key, ids in by_key.items():
            self.keywords.add_word(key, ids)
        self.keywords.make_automaton()

        ranks: dict[str, int] = {}
        for i, (r, _) in enumerate(self.rules):
            if r.kind == "spdx":
                ranks.setdefault(r.label, i)
        self.spdx = {i: (label, ranks[label]) for i, label in identifiers().items()}

    def expressions(self, text: str) -> list[Detection]:
        """Every known identifier of every SPDX expression, each by its own place: the rules read the
        first one behind the tag."""
        out = []
        for tag in TAG.finditer(text):
            at, depth, operand = tag.end(), 0, True
            while part := (INNER if depth else PART).match(text, at):
                word, at = part[1], part.end()
                if word in "()":
                    if (word == "(") != operand:
                        break  # a bracket that opens behind a name, or closes behind an operator
                    depth += 1 if word == "(" else -1
                    if depth < 0:
                        break
                elif operand:
                    ported = re.match(r"cc-[a-z-]+-\d\.\d(?!\d)", word)
                    name = next((n for n in (word, word.rstrip("."), word.rstrip(".+"), ported and ported[0]) if n in self.spdx), None)
                    if name:
                        label, rank = self.spdx[name]
                        out.append(Detection(part.start(1), part.start(1) + len(name), label, "spdx", rank))
                    operand = False
                elif word in ("and", "or", "with"):
                    operand = True
                else:
                    break
        return out

    def candidates(self, text: str) -> set[int]:
        found: set[int] = set()
        for _, ids in self.keywords.iter(text):
            found.update(ids)
        return found

    def scan(self, text: str) -> tuple[list[Detection], list[tuple[int, str]]]:
        """Detections that stand, by place, and all places (offset, label) of base phrases, of a text
        whose A-Z are lower case."""
        found, places = self.expressions(text), []
        for i in sorted(self.candidates(text)):
            if i < len(self.rules):
                rule, regex = self.rules[i]
                found += [Detection(m.start(), m.end(), rule.label, rule.kind, i) for m in regex.finditer(text)]
            else:
                rule, regex = self.base[i - len(self.rules)]
                places += [(m.start(), rule.label) for m in regex.finditer(text)]
        return resolve(found), sorted(places)


def resolve(found: list[Detection]) -> list[Detection]:
    """Drops detections that lie inside one of higher rank; what stands, by place. A prefix maximum of
    ends over starts (Fenwick tree) answers each containment in logarithmic time."""
    starts = sorted({d.start for d in found})
    furthest = [0] * (len(starts) + 1)
    stand: list[Detection] = []
    for d in sorted(found, key=lambda d: (-KINDS[d.kind][1], d.start - d.end, d.rank, d.start)):
        i = bisect.bisect_right(starts, d.start)
        at, reach = i, 0
        while at:
            reach = max(reach, furthest[at])
            at &= at - 1
        if reach < d.end:
            stand.append(d)
            while i < len(furthest):
                furthest[i] = max(furthest[i], d.end)
                i += i & -i
    return sorted(stand)


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def digest(text: str, scan: Scanner) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    low = text.encode().lower().decode()  # A-Z only
    n_words = len(WORDS.findall(low))
    stand, places = scan.scan(low)
    first = last = None
    if places:
        first = len(WORDS.findall(low, 0, places[0][0]))
        last = len(WORDS.findall(low, 0, places[-1][0]))
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(d.label for d in stand)})
    score = max([KINDS[d.kind][0] for d in stand] + [KINDS["base"][0]] * bool(places), default=0.0)
    spans = [{"label": d.label, "kind": d.kind, "start": d.start, "end": d.end} for d in stand]
    return n_words, len(places), first, last, ",".join(base), ",".join(labels), score, spans


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (label, kind, start, end in characters) for each row.

    Null text is empty: no words, no labels, score 0. Repeated rows are scanned each; other columns
    are not read. Map-only."""
    src = docs.select(F.col(doc_id).alias("doc_id"), common.whole_text(text).alias("text"))
    spans = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()),
                                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), spans]
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
    out = T.StructType([common.field(src, "doc_id")] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batch: pa.RecordBatch, scan: Scanner) -> pa.RecordBatch:
        rows = [digest(t.as_py(), scan) for t in batch.column(1)]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), arrow))], ["doc_id", *names])

    return common.map_arrow(src, run, out, scanner)

