import re

from corpus import awkward, frame

from fintally.llm import license_scan as S
from fintally.llm.license_rules import BASE, KINDS, rules

CASES = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Released under the MIT License.": "mit",
    "All rights reserved.": "reserved", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "see https://creativecommons.org/licenses/by-sa/4.0/ for more": "cc-by-sa-4.0", "under the open\ndatabase licence and cc\nby-nc 4.0": "cc-by,cc-by-nc-4.0,odbl-1.0",
    "ich komme mit licht": "", "Copyright (c) 2020 Foo": "copyright", "Mozilla Public License 2.0": "mpl-2.0", "the Mozilla Public License": "mpl",
}


def brute(text):
    """The contract's base columns, word by word; all rules in turn, without the keyword filter."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, phrase in BASE.items() for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase]
    found = [S.Detection(m.start(), m.end(), r.label, r.kind, n) for n, r in enumerate(rules()) for m in re.finditer(r.regex, low)]
    ranked = sorted(found, key=lambda d: (-KINDS[d.kind][1], d.start - d.end, d.rank, d.start))
    stand = []
    for d in ranked:
        if not any(s.start <= d.start and d.end <= s.end for s in stand):
            stand.append(d)
    base = sorted({p for _, p in places})
    starts = [i for i, _ in places]
    score = max([KINDS[d.kind][0] for d in stand] + [0.5] * bool(places), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(d.label for d in stand)})), score


def test_labels_of_known_lines():
    for text, want in CASES.items():
        assert S.digest(text, S.scanner())[5] == want, text


def test_rows_match_brute_force(spark):
    rows = awkward() + [(200 + i, t) for i, t in enumerate(CASES)] + [(300, " ".join(CASES) * 3), (301, "x cc--BY y CC by, all rights\nreserved")]
    got = S.scan_licenses(frame(spark, rows)).drop("detections").collect()
    assert sorted((str(tuple(r))) for r in got) == sorted(str((i, *brute(t))) for i, t in rows)
    assert S.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_hundreds_of_rules_and_linear_suppression():
    assert len(rules()) > 300
    many = [S.Detection(i, i + 3, "a", "title", 1) for i in range(30_000)] + [S.Detection(0, 10_000, "b", "spdx", 0)]
    assert len(S.resolve(many)) == 1 + sum(1 for i in range(30_000) if i + 3 > 10_000)


def test_names_without_license_and_texts():
    for text, want in {
        "Apache 2 is nice weather": "", "Apache helicopters, 2 of them": "", "licensed under the MIT License and Apache-2.0": "apache-2.0,mit",
        "BSD-3-Clause": "bsd-3-clause", "LGPL": "lgpl", "released under MIT": "mit", "released under the MIT license": "mit", "licensed under Apache 2": "apache-2.0",
        "Apache 2.0": "apache-2.0", "Apache 2 License": "apache-2.0", "released under mitigating conditions": "", "GPLv2+ or LGPL-2.1": "gpl-2.0,lgpl-2.1", "dual MIT-0": "mit-0",
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n * copies of the Software": "mit",
        "# Redistributions in binary form must reproduce the\n# above copyright notice": "bsd", "The origin of this software must not be misrepresented;": "zlib",
        "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.": "mpl-2.0", "under the same terms as Perl itself": "perl",
    }.items():
        assert S.digest(text, S.scanner())[5] == want, text


def variants(regex):
    """Matches of a regex: every choice of it (an optional part, a branch, a character of a class) taken in
    turn, the others at their first, then at their last."""
    def build(tree, pick):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name in ("NOT_LITERAL", "ANY"):
                out += "x"
            elif name == "IN":
                if str(arg[0][0]) == "NEGATE":
                    out += "x"
                else:
                    options = [c for kind, v in arg for c in ([chr(v)] if str(kind) == "LITERAL" else " \n" if str(kind) == "CATEGORY" else [chr(v[0]), chr(v[1])])]
                    out += options[pick(len(options))]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                for _ in range(low + (pick(2) if high > low else 0)):
                    out += build(inner, pick)
            elif name == "SUBPATTERN":
                out += build(arg[3], pick)
            elif name == "BRANCH":
                out += build(arg[1][pick(len(arg[1]))], pick)
            else:
                assert name == "ASSERT_NOT", name
        return out

    tree, found = re._parser.parse(regex), set()
    for last in (False, True):
        def run(at=None, value=None):
            sizes = []
            def pick(n):
                sizes.append(n)
                return value if len(sizes) - 1 == at else n - 1 if last else 0
            found.add(build(tree, pick))
            return sizes
        for at, n in enumerate(run()):
            for value in range(n):
                run(at, value)
    return found


def test_the_keyword_filter_drops_no_match_of_a_rule():
    scan = S.scanner()
    for i, (rule, regex) in enumerate(scan.rules + scan.base):
        matches = [t for t in variants(rule.regex) if regex.search(t)]
        assert matches, rule
        for text in matches:
            assert i in scan.candidates(text), (rule, text)


def test_open_rail_with_a_space_and_spdx_expressions():
    for text, want in {
        "under the CreativeML Open RAIL-M License": "openrail", "CreativeML OpenRAIL-M License": "openrail",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit", "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: (MIT OR (GPL-2.0+ AND CC-BY-4.0)) AND Zlib.": "cc-by,cc-by-4.0,gpl-2.0,mit,zlib",
        "SPDX-License-Identifier: ((ISC OR MIT) AND\n * Zlib)": "isc,mit,zlib",
        "SPDX-License-Identifier: Foo-1.0 OR GPL-2.0-only WITH Classpath-exception-2.0": "gpl-2.0",
        "SPDX-License-Identifier: MIT\nand json or ruby": "mit", "SPDX-License-Identifier: MIT json": "mit", "SPDX-License-Identifier:": "",
    }.items():
        n_words, *_, labels, score, spans = S.digest(text, S.scanner())
        assert labels == want, text
        assert not want or {d["kind"] for d in spans} <= {"spdx", "title", "grant"}
