"""Signature rules of the licence scan.

A rule is (label, kind, keyword, regex). Regexes see text whose A-Z are lower case. ``G`` stands for
what may separate two words, so a line break or punctuation does not hide a phrase. The keyword is a
string that every match of the regex holds: a rule is tried only on texts that hold it.
"""
from __future__ import annotations

from typing import NamedTuple

from fintally.llm.license_texts import GRANTS, MENTIONS, TEXTS

WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
G = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
START, END = f"(?<!{WORD})", f"(?!{WORD})"

#: Confidence and priority by kind of evidence: an identifier outweighs a title, a title a mention.
KINDS = {"spdx": (1.0, 5), "url": (0.95, 4), "text": (0.95, 4), "grant": (0.9, 3), "title": (0.8, 2), "mention": (0.7, 2), "notice": (0.6, 1), "base": (0.5, 0)}


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    regex: str


#: Base phrases: their words, consecutive.
BASE = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: label: (SPDX identifiers, names as regexes with their keyword, addresses). Order is rank: of two
#: rules of one kind that match the same place, the earlier wins.
FAMILIES: list[tuple[str, list[str], list[tuple[str, str]], list[str]]] = [
    ("apache-2.0", ["apache-2.0"], [("apache", r"apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?"), ("apache", r"apache[ -]2(?:\.0)? licen[cs]e"), ("asl", r"asl[ -]?2\.0")], ["apache.org/licenses/license-2.0"]),
    ("apache-1.1", ["apache-1.1"], [("apache", r"apache(?: software)? license,?(?: version| v\.?)? ?1\.1")], ["apache.org/licenses/license-1.1"]),
    ("apache-1.0", ["apache-1.0"], [("apache", r"apache(?: software)? license,?(?: version| v\.?)? ?1\.0")], ["apache.org/licenses/license-1.0"]),
    ("mit", ["mit"], [("mit", r"mit licen[cs]e"), ("mit", r"mit[ /-]x11 licen[cs]e"), ("expat", r"expat licen[cs]e")], ["opensource.org/licenses/mit", "opensource.org/license/mit"]),
    ("mit-0", ["mit-0"], [("mit", r"mit no attribution(?: license)?"), ("mit", r"mit-0 licen[cs]e")], ["opensource.org/licenses/mit-0"]),
    ("bsd-2-clause", ["bsd-2-clause", "bsd-2-clause-freebsd"], [("bsd", r"bsd 2[ -]clause(?: license)?"), ("bsd", r"(?:simplified|2[ -]clause|two[ -]clause|freebsd) bsd license")], ["opensource.org/licenses/bsd-2-clause"]),
    ("bsd-3-clause", ["bsd-3-clause", "bsd-3-clause-clear"], [("bsd", r"bsd 3[ -]clause(?: license)?"), ("bsd", r"(?:new|modified|revised|3[ -]clause|three[ -]clause) bsd license")], ["opensource.org/licenses/bsd-3-clause"]),
    ("bsd-4-clause", ["bsd-4-clause"], [("bsd", r"(?:original|4[ -]clause|four[ -]clause) bsd license")], ["spdx.org/licenses/bsd-4-clause"]),
    ("0bsd", ["0bsd"], [("bsd", r"zero[ -]clause bsd(?: license)?")], ["opensource.org/licenses/0bsd"]),
    ("agpl-3.0", ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], [("affero", r"(?:gnu )?affero general public licen[cs]e"), ("agpl", r"agpl ?v?3(?:\.0)?")], ["gnu.org/licenses/agpl-3.0", "gnu.org/licenses/agpl"]),
    ("lgpl-3.0", ["lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"], [("lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?3(?:\.0)?"), ("lgpl", r"lgpl ?v?3(?:\.0)?")], ["gnu.org/licenses/lgpl-3.0"]),
    ("lgpl-2.1", ["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"], [("lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?2\.1"), ("lgpl", r"lgpl ?v?2\.1")], ["gnu.org/licenses/old-licenses/lgpl-2.1", "gnu.org/licenses/lgpl-2.1"]),
    ("lgpl-2.0", ["lgpl-2.0", "lgpl-2.0-only", "lgpl-2.0-or-later"], [("library", r"(?:gnu )?library general public licen[cs]e"), ("lgpl", r"lgpl ?v?2(?:\.0)?")], ["gnu.org/licenses/old-licenses/lgpl-2.0"]),
    ("gpl-3.0", ["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-3.0+"], [("general", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?"), ("gpl", r"gpl ?v?3(?:\.0)?")], ["gnu.org/licenses/gpl-3.0"]),
    ("gpl-2.0", ["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0+"], [("general", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?"), ("gpl", r"gpl ?v?2(?:\.0)?")], ["gnu.org/licenses/old-licenses/gpl-2.0", "gnu.org/licenses/gpl-2.0"]),
    ("gpl-1.0", ["gpl-1.0", "gpl-1.0-only", "gpl-1.0-or-later"], [("general", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?")], ["gnu.org/licenses/old-licenses/gpl-1.0"]),
    ("gfdl-1.3", ["gfdl-1.3", "gfdl-1.3-or-later"], [("free documentation", r"(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1\.3")], ["gnu.org/licenses/fdl-1.3"]),
    ("gfdl-1.2", ["gfdl-1.2", "gfdl-1.2-or-later"], [("free documentation", r"(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1\.2")], ["gnu.org/licenses/fdl-1.2"]),
    ("gfdl", ["gfdl"], [("free documentation", r"(?:gnu )?free documentation licen[cs]e")], ["gnu.org/licenses/fdl", "gnu.org/copyleft/fdl"]),
    ("mpl-2.0", ["mpl-2.0"], [("mozilla", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?"), ("mpl", r"mpl ?v?2\.0")], ["mozilla.org/mpl/2.0"]),
    ("mpl-1.1", ["mpl-1.1"], [("mozilla", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?1\.1")], ["mozilla.org/mpl/1.1"]),
    ("epl-2.0", ["epl-2.0"], [("eclipse", r"eclipse public licen[cs]e,?(?: version| -)?(?: v\.?)? ?2\.0")], ["eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20"]),
    ("epl-1.0", ["epl-1.0"], [("eclipse", r"eclipse public licen[cs]e,?(?: version| -)?(?: v\.?)? ?1\.0")], ["eclipse.org/legal/epl-v10"]),
    ("eupl-1.2", ["eupl-1.2"], [("european union", r"european union public licen[cs]e,?(?: version| v\.?)? ?1\.2"), ("eupl", r"eupl ?v?1\.2")], ["joinup.ec.europa.eu/software/page/eupl"]),
    ("eupl-1.1", ["eupl-1.1"], [("european union", r"european union public licen[cs]e,?(?: version| v\.?)? ?1\.1")], ["ec.europa.eu/idabc/eupl"]),
    ("cddl-1.1", ["cddl-1.1"], [("common development", r"common development and distribution licen[cs]e,?(?: version| v\.?)? ?1\.1")], ["glassfish.java.net/public/cddl+gpl_1_1"]),
    ("cddl-1.0", ["cddl-1.0"], [("common development", r"common development and distribution licen[cs]e"), ("cddl", r"cddl ?v?1\.0")], ["opensource.org/licenses/cddl-1.0"]),
    ("cpl-1.0", ["cpl-1.0"], [("common public", r"common public licen[cs]e")], ["opensource.org/licenses/cpl1.0"]),
    ("artistic-2.0", ["artistic-2.0"], [("artistic", r"artistic licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?")], ["opensource.org/licenses/artistic-2.0"]),
    ("artistic-1.0", ["artistic-1.0"], [("artistic", r"artistic licen[cs]e,?(?: version| v\.?)? ?1(?:\.0)?")], ["opensource.org/licenses/artistic-1.0"]),
    ("isc", ["isc"], [("isc", r"isc licen[cs]e")], ["opensource.org/licenses/isc"]),
    ("zlib", ["zlib"], [("zlib", r"zlib(?:/libpng)? licen[cs]e")], ["opensource.org/licenses/zlib"]),
    ("bsl-1.0", ["bsl-1.0"], [("boost", r"boost software licen[cs]e(?:,? (?:version |v)?1\.0)?")], ["boost.org/license_1_0"]),
    ("busl-1.1", ["busl-1.1"], [("business source", r"business source licen[cs]e(?:,? (?:version |v)?1\.1)?")], ["mariadb.com/bsl11"]),
    ("sspl-1.0", ["sspl-1.0"], [("server side", r"server side public licen[cs]e")], ["mongodb.com/licensing/server-side-public-license"]),
    ("elastic-2.0", ["elastic-2.0"], [("elastic", r"elastic licen[cs]e(?: 2\.0)?")], ["elastic.co/licensing/elastic-license"]),
    ("unlicense", ["unlicense"], [("unlicense", r"(?:the )?unlicense")], ["unlicense.org"]),
    ("wtfpl", ["wtfpl"], [("wtfpl", r"wtfpl"), ("do what the", r"do what the f[*u]ck you want to public licen[cs]e")], ["wtfpl.net"]),
    ("cc0-1.0", ["cc0-1.0"], [("cc0", r"cc0(?: 1\.0)?(?: universal)?"), ("creative commons", r"creative commons zero")], ["creativecommons.org/publicdomain/zero/1.0"]),
    ("psf-2.0", ["psf-2.0", "python-2.0"], [("python", r"python software foundation licen[cs]e")], ["python.org/psf/license", "docs.python.org/3/license"]),
    ("ruby", ["ruby"], [("ruby", r"ruby licen[cs]e")], ["ruby-lang.org/en/about/license.txt"]),
    ("php-3.01", ["php-3.01"], [("php", r"php licen[cs]e,?(?: version| v\.?)? ?3\.01")], ["php.net/license/3_01"]),
    ("ofl-1.1", ["ofl-1.1"], [("open font", r"(?:sil )?open font licen[cs]e(?:,? (?:version |v)?1\.1)?")], ["scripts.sil.org/ofl", "openfontlicense.org"]),
    ("odbl-1.0", ["odbl-1.0"], [("open database", r"open (?:data commons open )?database licen[cs]e")], ["opendatacommons.org/licenses/odbl"]),
    ("odc-by-1.0", ["odc-by-1.0"], [("open data commons", r"open data commons attribution licen[cs]e")], ["opendatacommons.org/licenses/by"]),
    ("pddl-1.0", ["pddl-1.0"], [("public domain dedication", r"public domain dedication and licen[cs]e")], ["opendatacommons.org/licenses/pddl"]),
    ("ms-pl", ["ms-pl"], [("microsoft", r"microsoft public licen[cs]e")], ["opensource.org/licenses/ms-pl"]),
    ("ms-rl", ["ms-rl"], [("microsoft", r"microsoft reciprocal licen[cs]e")], ["opensource.org/licenses/ms-rl"]),
    ("openssl", ["openssl"], [("openssl", r"openssl licen[cs]e")], ["openssl.org/source/license"]),
    ("postgresql", ["postgresql"], [("postgresql", r"postgresql licen[cs]e")], ["opensource.org/licenses/postgresql", "postgresql.org/about/licence"]),
    ("ncsa", ["ncsa"], [("illinois", r"university of illinois/ncsa open source licen[cs]e"), ("ncsa", r"ncsa open source licen[cs]e")], ["opensource.org/licenses/ncsa", "opensource.org/licenses/uoi-ncsa"]),
    ("afl-3.0", ["afl-3.0"], [("academic free", r"academic free licen[cs]e(?:,? (?:version |v)?3\.0)?")], ["opensource.org/licenses/afl-3.0"]),
    ("osl-3.0", ["osl-3.0"], [("open software", r"open software licen[cs]e(?:,? (?:version |v)?3\.0)?")], ["opensource.org/licenses/osl-3.0"]),
    ("ecl-2.0", ["ecl-2.0"], [("educational community", r"educational community licen[cs]e")], ["opensource.org/licenses/ecl-2.0"]),
    ("vim", ["vim"], [("vim", r"vim licen[cs]e")], ["vimdoc.sourceforge.net/htmldoc/uganda"]),
    ("json", ["json"], [("used for good", r"shall be used for good, not evil")], ["json.org/license"]),
    ("openrail", ["openrail", "bigscience-openrail-m"], [("rail", r"(?:creativeml )?open ?rail(?:\+\+)?(?:-m)? licen[cs]e"), ("openrail", r"openrail(?:\+\+)?-m")], ["huggingface.co/spaces/bigscience/license"]),
    ("ogl-uk-3.0", ["ogl-uk-3.0"], [("open government", r"open government licen[cs]e(?:,? v?3\.0)?")], ["nationalarchives.gov.uk/doc/open-government-licence/version/3"]),
]

#: The Creative Commons suite: elements of the licence by name, and its versions.
CC_ELEMENTS = {"by": "attribution", "by-sa": "attribution[ -]share ?alike", "by-nd": "attribution[ -]no ?derivati?ve?s?(?: works)?",
               "by-nc": "attribution[ -]non-?commercial", "by-nc-sa": "attribution[ -]non-?commercial[ -]share ?alike",
               "by-nc-nd": "attribution[ -]non-?commercial[ -]no ?derivati?ve?s?(?: works)?"}
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")

#: Notices that name no licence of the list.
NOTICES = [
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"no copyright[^.\n]{0,40}public domain"),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}"),
    ("copyright", "©", r"© ?(?:copyright )?(?:19|20)[0-9]{2}"),
    ("copyright", "(c)", r"\(c\) ?(?:19|20)[0-9]{2}"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "without the prior", r"without the prior written (?:permission|consent) of"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)"),
    ("proprietary", "may not be reproduced", r"may not be reproduced"),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("zlib", "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc", "creative commons", r"creative commons(?: licen[cs]e)?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("gpl", "gnu", r"gnu (?:gpl|public licen[cs]e)"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
]


def quoted(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def gaps(pattern: str) -> str:
    """Each space of a pattern may be any white space."""
    return pattern.replace(" ", r"\s+").replace(r"\s+?", r"\s*")


def phrase(pattern: str) -> str:
    """Each space of a pattern may be whatever separates two words."""
    return pattern.replace(" ?", f"(?:{G})?").replace(" ", G)


def rules() -> list[Rule]:
    """All rules in rank order; a few hundred."""
    out: list[Rule] = []
    licensed = r"(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?"
    for label, ids, names, urls in FAMILIES:
        out += [Rule(label, "spdx", "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?{quoted(i)}(?![\w.+-]*\w)") for i in ids]
        out += [Rule(label, "url", u, quoted(u)) for u in urls]
        out += [Rule(label, "grant", key, gaps(licensed + name)) for key, name in names]
        out += [Rule(label, "title", key, gaps(name)) for key, name in names]
    for elements, words in CC_ELEMENTS.items():
        for version in CC_VERSIONS:
            label, v = f"cc-{elements}-{version}", quoted(version)
            short = elements.replace("-", r"[\s-]")
            out.append(Rule(label, "spdx", "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?cc-{quoted(elements)}-{v}(?!\d)"))
            out.append(Rule(label, "url", f"creativecommons.org/licenses/{elements}/{version}", quoted(f"creativecommons.org/licenses/{elements}/{version}")))
            out.append(Rule(label, "grant", version, gaps(licensed) + rf"cc[\s-]{short}[\s-]?v?{v}"))
            out.append(Rule(label, "title", version, rf"cc[\s-]{short}[\s-]?v?{v}"))
            out.append(Rule(label, "title", "creative commons", gaps(rf"creative commons {words},? {v}")))
            out.append(Rule(label, "title", "creative commons", gaps(rf"creative commons {words},? {v}(?: international| unported| generic)? licen[cs]e")))
    out += [Rule(label, "text", key, phrase(p)) for label, key, p in TEXTS]
    out += [Rule(label, "grant", key, gaps(licensed) + rf"(?:an? )?{phrase(p)}") for label, key, p in GRANTS]
    out += [Rule(label, "mention", key, phrase(p)) for label, key, p in MENTIONS]
    out += [Rule(label, "notice", key, gaps(p)) for label, key, p in NOTICES]
    return [Rule(r.label, r.kind, r.keyword, f"{START}(?:{r.regex}){END}") for r in out]


def identifiers() -> dict[str, str]:
    """The label of every SPDX identifier."""
    suite = [f"cc-{elements}-{version}" for elements in CC_ELEMENTS for version in CC_VERSIONS]
    return {i: label for label, ids, _, _ in FAMILIES for i in ids} | dict(zip(suite, suite))


def base_rules() -> list[Rule]:
    return [Rule(label, "base", words[0], START + G.join(words) + END) for label, words in BASE.items()]
