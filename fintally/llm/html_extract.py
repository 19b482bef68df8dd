"""Main text of web pages by tree scoring.

A forgiving parser builds the element tree. Paragraphs pass points for their length and commas to
their ancestors, less with distance; an ancestor's points are discounted by its link density. The best
container is kept, with those siblings that look like part of the article; page furniture inside
it (menus, notices, adverts, forms, reader comments ...) is left out.
"""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[="'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
SPACES = re.compile(r"\s+")

VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style noscript noframes template iframe textarea title xmp svg math object canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
#: An element of the key ends an open element of the values, up to the nearest element of SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
TABLE = {"table"}

FURNITURE = frozenset("nav header footer aside form button select menu dialog search fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox adsense banner billboard breadcrumb breadcrumbs byline-share comment comments
commentlist consent cookie cookies disqus disclaimer footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices
overlay pager pagination paywall popup popups promo promoted promotion recommended related remark replies reply respond rss share sharing shoutbox sidebar sidebars
sidenav signup skip skyscraper social sponsor sponsored sponsors subscribe subscription syndication tags teaser toolbar topbar topnav widget widgets""".split())
#: Of these, the words that name parts of a layout and so also stand in the class of what holds them all ("has-sidebar").
LAYOUT_WORDS = frozenset("""banner breadcrumb breadcrumbs footer header hidden login masthead menu menus modal nav navbar navigation overlay pager pagination rss share
sharing sidebar sidebars sidenav skip social tags toolbar topbar topnav widget widgets""".split())
CONTENT_WORDS = frozenset("article body content entry hentry main page post story text blog column".split())
NAME_PARTS = re.compile(r"[^\W_]+(?:-?[^\W_]+)*")
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
BASE_POINTS = {"article": 10, "main": 8, "section": 2, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "body": -2}
MIN_PARAGRAPH, DEPTH = 25, 6


MARKED, HEADINGS = frozenset(("article", "main")), frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    """``furniture``: "no", "yes", or "layout" (by a word that may also stand on what holds the article); ``out``: whether
    it is left out; ``marked``: the article or main elements around it, nearest first, three at most."""
    __slots__ = ("tag", "parent", "items", "names", "furniture", "out", "marked", "length", "linked", "commas", "points")

    def __init__(self, tag: str, parent: Element | None, names: frozenset = frozenset(), furniture: str = "no"):
        self.tag, self.parent, self.names, self.furniture, self.out = tag, parent, names, furniture, False
        self.marked: tuple = () if parent is None else ((parent, *parent.marked) if parent.tag in MARKED else parent.marked)[:3]
        self.items: list = []  # elements and strings, in order
        self.length = self.linked = self.commas = 0
        self.points = 0.0

    @property
    def is_title(self) -> bool:
        """The header of an article: its headings stay, all else of it goes."""
        return self.tag == "header" and bool(self.marked) and self.furniture == "yes"


def describe(tag: str, raw: str) -> tuple[frozenset, str]:
    """The words of class and id, and whether the element is page furniture."""
    if not raw or raw.isspace():
        return frozenset(), "yes" if tag in FURNITURE else "no"
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = frozenset(re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    out = tag in FURNITURE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if out or "display:none" in found.get("style", "").replace(" ", "").lower():
        return words, "yes"
    if tag in ("html", "body") or not (said := words & FURNITURE_WORDS):
        return words, "no"
    if tag in MARKED:  # a reader's comment can be an article of its own
        return words, "yes" if words & {"comment", "comments", "reply", "replies", "teaser", "related", "promo", "sponsored"} else "no"
    if words & {"article", "content", "entry", "post", "story"} and not words & {"comments", "comment", "related", "sidebar", "ad", "ads", "footer", "nav", "menu"}:
        return words, "no"
    return words, "layout" if said <= LAYOUT_WORDS else "yes"


def settle(root: Element) -> None:
    """Decides what is left out. An element named like a part of the layout is left out unless it holds most of the
    page's paragraph text: then it is the layout itself."""
    order, stack, layouts = [], [root], False
    while stack:
        node = stack.pop()
        order.append(node)
        layouts = layouts or node.furniture == "layout"
        stack += [x for x in node.items if isinstance(x, Element) and x.furniture != "yes"]
    prose: dict[int, int] = {}
    if layouts:
        for node in reversed(order):
            own = sum(len(x.strip()) for x in node.items if isinstance(x, str)) if node.tag in PARAGRAPHS or node.tag in CONTAINERS else 0
            prose[id(node)] = (own if own >= MIN_PARAGRAPH else 0) + sum(prose.get(id(x), 0) for x in node.items if isinstance(x, Element))
    most = prose.get(id(root), 0) / 2
    stack = [root]
    while stack:
        node = stack.pop()
        for x in node.items:
            if isinstance(x, Element):
                own = x.furniture == "yes" or x.furniture == "layout" and not (most and prose.get(id(x), 0) > most)
                title = node.out and x.tag in HEADINGS and x.furniture == "no" and in_title(x)
                x.out = (node.out or own) and not title
                stack.append(x)


def in_title(node: Element) -> bool:
    """Whether a heading stands in an article's header, at most a few elements deep, and in no other furniture."""
    up = node.parent
    for _ in range(DEPTH):
        if up is None or up.is_title:
            return up is not None and not up.parent.out
        if up.furniture != "no":
            return False
        up = up.parent
    return False


def parse(page: str) -> Element:
    """The element tree. End tags without a start are skipped, open elements end where HTML lets them."""
    root = node = Element("html", None)
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                node.items.append(page[at:])
            settle(root)
            return root
        if m.start() > at:
            node.items.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.items.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ("html", "body") and (tag == "html" or any(isinstance(x, Element) and x.tag == "body" for x in root.items)):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        node = made_room(node, tag, root)
        child = Element(tag, node, *describe(tag, m[3]))
        node.items.append(child)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            node = child


def made_room(node: Element, tag: str, root: Element) -> Element:
    """Where an element ``tag`` is put, after the elements that its start tag ends."""
    ends = {"p"} if tag in CLOSES_P else set()
    ends |= ENDS.get(tag, set())
    if not ends:
        return node
    stop = SCOPE.get(tag, TABLE)
    place, up = node, node
    while up is not root and up.tag not in stop:
        if up.tag in ends:
            place = up.parent
        elif up.tag in BLOCK and tag in CLOSES_P and tag not in ENDS:
            break  # a paragraph ends only within its own block
        up = up.parent
    return place


def measure(root: Element) -> list[Element]:
    """Sets the lengths of the text of every element, and the part inside links; children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Element) and not x.out]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.length += len(SPACES.sub(" ", x).strip())
                node.commas += x.count(",") + x.count("、") + x.count("，")
            elif not x.out:
                node.length += x.length
                node.commas += x.commas
                node.linked += x.linked
        if node.tag == "a":
            node.linked = node.length
    return order


def link_density(node: Element) -> float:
    return node.linked / node.length if node.length else 0.0


def is_paragraph(node: Element) -> bool:
    # a cell that holds paragraphs is a container of theirs, and no paragraph beside
    return node.tag in PARAGRAPHS - CONTAINERS or node.tag in CONTAINERS and any(isinstance(x, str) and len(x.strip()) >= MIN_PARAGRAPH for x in node.items)


def best_container(root: Element) -> Element | None:
    """The element with the most points; None if the page has no paragraph to score."""
    order = measure(root)
    scored: dict[int, Element] = {}
    for node in order:
        if node.length >= MIN_PARAGRAPH and is_paragraph(node):
            points = 1 + node.commas + min(node.length // 100, 3)
            holder = node.parent if node.tag in PARAGRAPHS else node
            shares, up = [], holder
            for level in range(DEPTH):
                if up is not None and up.tag not in MARKED:
                    shares.append((up, points / (1 if level == 0 else 2 if level == 1 else 3 * level)))
                up = up.parent if up is not None else None
            # what the page marks as its article takes its paragraphs' points in full, at any depth
            shares += [(up, points) for up in ((holder, *holder.marked) if holder.tag in MARKED else holder.marked)]
            for up, share in shares:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.points += BASE_POINTS.get(up.tag, 0) + 25 * bool(up.names & CONTENT_WORDS)
                up.points += share
    for node in scored.values():
        node.points *= 1 - link_density(node)
    return max(scored.values(), key=lambda n: n.points, default=None)


def chosen(root: Element) -> list[Element]:
    """The best container with the siblings that belong to it, in page order."""
    best = best_container(root)
    marked = [n for n in order_of(root) if n.tag in ("article", "main") and not n.out and n.length]
    if best is None:
        return [max(marked, key=lambda n: n.length) if marked else next((x for x in root.items if isinstance(x, Element) and x.tag == "body"), root)]
    if best.parent is None:
        return [best]
    limit = max(10.0, best.points * 0.2)
    kept = []
    for x in best.parent.items:
        if not isinstance(x, Element) or x.out:
            continue
        alike = bool(x.names) and x.names == best.names
        if x is best:
            kept.append(x)
        elif best.tag in MARKED:  # beside a marked article, only its further parts
            if alike and x.tag == best.tag and x.points >= limit:
                kept.append(x)
        elif x.points + best.points * 0.2 * alike >= limit or x.tag in ("p", "h1", "h2", "pre", "blockquote") and x.length and link_density(x) < 0.25:
            kept.append(x)
    return kept


def order_of(root: Element):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.items) if isinstance(x, Element)]


def blocks(nodes: list[Element]) -> list[str]:
    """The text blocks below the nodes, in page order; one space for each stretch of white space."""
    out, current = [], []

    def close():
        text = SPACES.sub(" ", html.unescape("".join(current))).strip()
        if text:
            out.append(text)
        current.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            current.append(x)
        elif x.is_title and not x.parent.out:
            stack += reversed([h for h in order_of(x) if not h.out and h.tag in HEADINGS])
        elif not x.out or x in nodes:
            if x.tag == "br":
                current.append(" ")
            elif x.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(x.items)
    close()
    return out


def main_text(page: str) -> str:
    root = parse(page)
    return "\n".join(blocks(chosen(root)))


def extract_pages(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, text and n_chars (code points) for each row.

    Null or empty html gives an empty text; markup that never ends is read to its end; repeated rows
    are read each; an empty table gives no rows; other columns are not read. Of an article's own header the headings
    stay; noscript goes, as it stands for what scripts show. Map-only."""
    src = pages.select(*keys, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    out = T.StructType([src.schema[k] for k in keys] + [T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(x.as_py()) for x in batch.column(len(keys))], pa.string())
        return pa.record_batch([*batch.columns[:len(keys)], texts], [*keys, "text"])

    return common.map_arrow(src, run, out).withColumn("n_chars", F.length("text").cast("long"))
