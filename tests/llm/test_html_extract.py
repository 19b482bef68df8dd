import html as H

import duckdb
import pytest

from fintally.llm.html_extract import extract_pages, main_text

ARTICLE = "<p>Real text, with commas, and of enough length to count as a paragraph here.</p>"
CASES = [
    ("", ""), ("plain text only", "plain text only"), ("<p>hi", "hi"), ("<!-- open", ""), ("<div" * 3, ""),
    ("<article><h1>T</h1></article>", "T"),
    ("<nav><a href=/x>menu</a></nav><article><h1>Title</h1>" + ARTICLE + "<aside>side</aside><form>f<input></form><script>var a='</p>';</script>tail</article><footer>foot</footer>",
     "Title\nReal text, with commas, and of enough length to count as a paragraph here.\ntail"),
    ("<article><p><b>first, unclosed<br><p>second &amp;&lt;b&gt;\n  and&nbsp;more</article>", "first, unclosed\nsecond &<b> and more"),
    ("<body><div class='sidebar'><p>x, y, z and a long text at the side that nobody wants to read at all</p></div><div id=content>" + ARTICLE + "<p>Second.</div>"
     "<div class='comments'><p>a comment, a comment, a comment, a comment, and a long one at that</p></div><div class='cookie-notice'>We use cookies, as all do, all over the place.</div>",
     "Real text, with commas, and of enough length to count as a paragraph here.\nSecond."),
    ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>cell one is long enough to be a paragraph<td>two</table>", "cell one is long enough to be a paragraph\ntwo"),
    ("<main><section>" + ARTICLE + "</section><section><p>Short.</p></section><div class='related'><a href=1>more, more and more of the same, on and on</a></div></main>",
     "Real text, with commas, and of enough length to count as a paragraph here.\nShort."),
    ('<p title="a>b">q</p>', "q"), ("<style>p{}</style><noscript>no</noscript><textarea><p>t</textarea>x", "x"),
    ("<div hidden>gone and hidden, all of this, yes</div><div style='display: none'>gone too, all of it, for good</div><p>kept</p>", "kept"),
]

TEXT = "Real text, with commas, and of enough length to count as a paragraph here."
CASES += [
    # quotes open a value only behind the equals sign
    ("<p data-x=don't>" + "Kept, all of it, as it should be.</p><p>It's \"here\", too, and of some length.</p>", "Kept, all of it, as it should be.\nIt's \"here\", too, and of some length."),
    ('<p title = "a > b" x=y"z>q</p><p class="open>never closed', "q"),
    # words of a layout on what holds the article
    ("<div class='layout has-sidebar'><div class='sidebar'><p>Links, links and more links that nobody reads.</p></div><div class='text'>" + ARTICLE * 3 + "</div></div>", "\n".join([TEXT] * 3)),
    ("<div class='page with-nav header-fixed'><article>" + ARTICLE + "</article></div>", TEXT),
    # an article's header keeps its headings
    ("<article><header><h1>Title</h1><p>by someone, on some day, in some place</p></header>" + ARTICLE + "</article>", "Title\n" + TEXT),
    ("<header><h1>Site</h1></header><article><header><div><h2>Title</h2><nav><h3>no</h3></nav></div></header>" + ARTICLE + "</article>", "Title\n" + TEXT),
    # pages without article or main: the scores choose
    ("<body><div><h2>Head</h2>" + ARTICLE * 4 + "</div><div><p>Short, but a paragraph.</p></div><p>A paragraph beside the container, of some length.</p></body>", "Head\n" + "\n".join([TEXT] * 4) + "\nA paragraph beside the container, of some length."),
    ("<table><tr><td><a href=1>one, of many</a> <a href=2>two, of as many</a><td>" + ARTICLE * 2 + "</table>", "\n".join([TEXT] * 2)),
    # several articles: the best one; a reader's comment can be one too
    ("<article class=teaser>" + ARTICLE + "</article><article>" + ARTICLE * 3 + "</article><article class='comment'>" + ARTICLE * 5 + "</article>", "\n".join([TEXT] * 3)),
    # comments longer than the article stay out, whatever they hold
    ("<div id=main>" + ARTICLE + "</div><div class='comments sidebar'>" + ARTICLE * 9 + "</div>", TEXT),
    ("<main><div><div><div><div><div><div><div><div>" + ARTICLE + "</div></div></div></div></div></div></div></div><h2>Further down</h2></main>", TEXT + "\nFurther down"),
]


def plain_points(page):
    """The points of every container by their rule, said once more without the operator's tables."""
    from fintally.llm import html_extract as X
    root = X.parse(page)
    X.measure(root)
    out = {}
    for node in X.order_of(root):
        if node.out or node.length < 25 or not X.is_paragraph(node):
            continue
        points = 1 + node.commas + min(node.length // 100, 3)
        holder = node.parent if node.tag in X.PARAGRAPHS else node
        line, up = [], holder
        while up is not None:
            line.append(up)
            up = up.parent
        for level, up in enumerate(line):
            if up.tag in ("article", "main"):
                share = points
            elif level < 6:
                share = points / [1, 2, 6, 9, 12, 15][level]
            else:
                continue
            out.setdefault(id(up), [up, X.BASE_POINTS.get(up.tag, 0) + 25 * bool(up.names & X.CONTENT_WORDS)])[1] += share
    return {(n.tag, round(p * (1 - X.link_density(n)), 6)) for n, p in out.values()}


def test_points_by_their_rule():
    from fintally.llm import html_extract as X
    for page, _ in CASES:
        root = X.parse(page)
        best = X.best_container(root)
        want = plain_points(page)
        assert best is None or {(n.tag, round(n.points, 6)) for n in X.order_of(root) if n.points} <= want
        if best is not None:
            assert round(best.points, 6) == max(p for _, p in want)


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert main_text(page) == want


def test_links_weigh_against_a_container():
    menu = "<div>" + "".join(f"<a href=/{i}>A link, with words, number {i}, and more of them</a> " for i in range(30)) + "</div>"
    body = "<div>" + ARTICLE * 3 + "</div>"
    assert main_text(f"<body>{menu}{body}</body>").split("\n") == ["Real text, with commas, and of enough length to count as a paragraph here."] * 3


def test_whole_table_against_the_known_template(spark):
    """The table's pages hold their text in one article of h1 and p."""
    import re
    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>|<br>", inside[1]) if inside else []
        want = "\n".join(y for p in parts if (y := " ".join(H.unescape(re.sub("</?b>", "", p)).split())))
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, want, len(want))


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", None), (3, "u", "<p>" * 30_000 + "deep, and deeper", "x"), (4, "u", "<" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_pages(pages).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, 3, 4, None] and [r[2][:4] for r in got] == ["", "", "deep", got[3][2][:4], ""]
    assert extract_pages(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert extract_pages(pages.limit(0)).count() == 0
