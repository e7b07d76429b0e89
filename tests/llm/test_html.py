from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import html_extract as hx


class Brute(HTMLParser):
    """The article's blocks of plainly marked pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.run = False, [], ""

    def cut(self):
        if self.inside and self.run.split():
            self.blocks.append(" ".join(self.run.split()))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article", "li", "ul", "div"):
            self.cut()
        if tag == "br":
            self.run += " "
        if tag == "article":
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "li", "ul", "div"):
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        self.run += data


def test_query_against_another_parser(spark, sf):
    from tallyforge.llm.queries import op7_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op7_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        b = Brute()
        b.feed(pages[r.page_id].html)
        b.close(), b.cut()
        assert r.text == "\n".join(b.blocks) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five</article><footer>no</footer>", "A & B\none two three\nfour five"),
        ("<body class='has-sidebar'><div class='x-sidebar'><main><p>in</p><aside>out</aside></main></div>", "in"), ("<article><header><h1>T</h1></header><p>x</p><div class='share-bar'>s</div><section id=comments><article>c</article></section></article>", "T\nx"),
        ("<article><p>a</p><script>var t='<p>no</p>'</script><style>p{}</style><form>f<p>g</form><nav>n</nav><!-- <p>c</p> --><p>z", "a\nz"), ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
        ("<article><p>a &lt;b&gt; &#233; &nbsp; &eacute;&amp;amp;</p><p hidden>h</p><p style='display:none'>i</p></article>", "a <b> é é&amp;"), ("<p>x<div role=navigation>n</div><div class='cookie-notice'>c</div><p>y", "x\ny"), ("<article><p>cut <b", "cut"), ("<article><p>a<!-- open", "a"),
        ("<div class='layout no-sidebar'><p>a</p></div><div class='with-footer'>b</div><div class='ad-hoc'>c</div><div class='top-ad'>d</div>", "a\nb\nc"), ("<article hidden>x</article><article class='ad'>y</article><div>z</div>", "z"), ("<article class='ad'>y</article><article>z</article>", "z"),
        ("<div><p>1 < 2</p></div>", "1 < 2"), ("<article><div class=ad>x</div><div class='add'>y</div></article>", "y"),
    ],
)
def test_pages(page, want):
    assert "\n".join(hx.blocks(page)[0]) == want


def test_suffix_array():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 50):
        t = rnd.integers(0, 3, n)
        assert hx.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_repeated_windows():
    rnd = np.random.default_rng(2)
    page = np.repeat(np.arange(6), 40)
    t = rnd.integers(0, 3, 240)
    t[39::40] = -np.arange(1, 7)
    got = hx.repeated_windows(t, page, 5)
    where = {}
    for i in range(236):
        where.setdefault(tuple(t[i : i + 5]), set()).add(page[i])
    want = [i < 236 and len(where[tuple(t[i : i + 5])]) > 1 for i in range(240)]
    assert got.tolist() == want


@pytest.mark.parametrize("shard", [400_000, 60])
def test_unmarked_pages_lose_what_the_host_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(hx, "SHARD_TOKENS", shard)
    menu = "home news sport weather travel money culture video more about us"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>{' '.join(f'w{i}x{k}' for k in range(12))}</div><div>short</div>") for i in range(12)]
    rows += [(99, "http://other.example/", f"<div>{menu}</div>"), (100, None, "<div>alone</div>"), (None, "http://h.example/", None), (5, rows[5][1], rows[5][2])]
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit(1)})).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[99] == menu and text[100] == "alone" and text[None] == ""
    assert text[0] == f"{' '.join(f'w0x{k}' for k in range(12))}\nshort"  # too short a block to be a run
    assert hx.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mirrors_and_short_headings_stay(spark):
    same = "<h1>Introduction</h1><p>one page that stands at two addresses of its host, word for word</p>"
    rows = [(1, "http://m.example/a", same), (2, "http://m.example/b", same), (3, "http://m.example/c", "<h1>Introduction</h1><p>another text</p>")]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Introduction\none page that stands at two addresses of its host, word for word" and got[3] == "Introduction\nanother text"


@pytest.mark.parametrize("shard", [400_000, 300])
def test_runs_against_brute_force_on_unmarked_copies(spark, sf, monkeypatch, shard):
    """The given pages with the marks of their main part taken out."""
    import re
    from collections import defaultdict

    monkeypatch.setattr(hx, "SHARD_TOKENS", shard)
    given = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = [(r.page_id, r.url, re.sub("(?i)</?(article|main)[^>]*>", "<hr>", r.html)) for r in given]
    host = lambda u: u.split("/")[2].lower()
    cut = {i: "\n".join(hx.blocks(h)[0]) for i, _, h in rows}
    on = defaultdict(set)
    for i, u, _ in rows:
        w = cut[i].split()
        for k in range(len(w) - hx.MIN_RUN + 1):
            on[host(u), tuple(w[k : k + hx.MIN_RUN])].add(cut[i])
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, u, _ in rows:
        w = cut[i].split()
        starts = [k for k in range(len(w) - hx.MIN_RUN + 1) if len(on[host(u), tuple(w[k : k + hx.MIN_RUN])]) > 1]
        assert got[i] == hx.without_runs(cut[i], starts)


@pytest.mark.parametrize("mark", ["alert-box", "related-articles", "share-buttons", "page-notice", "social-share", "relatedPosts", "searchBox", "userComments", "notice-bar", "widget-area", "skip-link", "site-header", "main-menu", "search-box", "related-posts", "menu-item", "recommended-reading"])
@pytest.mark.parametrize("page", ["<article><p>a</p><div class='{}'>x</div><p>b</p></article>", "<main><p>a</p><section id='{}'>x</section><p>b</p></main>", "<p>a</p><div class='box {} wide'>x</div><p>b</p>"])
def test_compound_marks(page, mark):
    assert hx.blocks(page.format(mark))[0] == ["a", "b"]


@pytest.mark.parametrize("mark", ["article-header", "entry-header", "post-header", "section-header", "market-share-table", "no-menu", "without-search", "research", "shared-house", "alerting", "time-share", "interrelated", "hasWidget", "noticeable", "menus"])
def test_words_that_only_look_marked(mark):
    assert hx.blocks(f"<article><p>a</p><div class='{mark}'>x</div><p>b</p></article>")[0] == ["a", "x", "b"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a</p><div id=respond>leave a reply</div>", ["a"]), ("<article><p>long main text of the page</p></article><article class='teaser'><p>other story, longer than the main one is</p></article>", ["long main text of the page"]),
        ("<main><article><h1>T</h1><p>the main article, of some length</p></article><p>note</p><article><p>next</p></article></main>", ["T", "the main article, of some length", "note"]),
        ("<article><p>first post of a day</p></article><article><p>second post, as long</p></article>", ["first post of a day", "second post, as long"]), ("<article class=card><p>one card here</p></article><article class=card><p>two cards here</p></article>", ["one card here", "two cards here"]),
        ("<article><p>outer text that is long</p><article><p>inner</p></article><p>end</p></article>", ["outer text that is long", "inner", "end"]), ("<article><header class='article-header'><h1>T</h1></header><p>x</p></article>", ["T", "x"]),
    ],
)
def test_main_article_and_comment_forms(page, want):
    assert hx.blocks(page)[0] == want


@pytest.mark.parametrize("shard", [400_000, 40])
def test_marked_pages_lose_what_most_pages_of_the_host_repeat(spark, monkeypatch, shard):
    """A plea in every article goes; what two articles of six share, and what all of a host of three share, stays."""
    monkeypatch.setattr(hx, "SHARD_TOKENS", shard)
    plea = "please support our work with a small gift today or become a member"
    quote = "this sentence of eight words stands on two of the pages"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    page = lambda i, more: f"<article><p>{own(i)}</p><p>{plea}</p>{more}</article>"
    rows = [(i, f"http://h.example/{i}", page(i, f"<p>{quote}</p>" if i < 2 else "")) for i in range(6)]
    rows += [(10 + i, f"http://few.example/{i}", page(10 + i, "")) for i in range(3)] + [(20, rows[5][1], rows[5][2])]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own(i) + (f"\n{quote}" if i < 2 else "") for i in range(6)} | {10 + i: f"{own(10 + i)}\n{plea}" for i in range(3)} | {20: own(5)}


def test_window_pages():
    rnd = np.random.default_rng(3)
    page = np.repeat(np.arange(6), 40)
    t = rnd.integers(0, 3, 240)
    where = {}
    for i in range(236):
        where.setdefault(tuple(t[i : i + 5]), set()).add(page[i])
    assert hx.window_pages(t, page, 5).tolist() == [len(where[tuple(t[i : i + 5])]) if i < 236 else 0 for i in range(240)]
