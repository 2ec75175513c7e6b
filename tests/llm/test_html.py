"""Wrapper inference and extraction on made-up sites."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from weftgraph.llm import html_extract as x

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- c --><div class="ad">Buy {n}</div>
<article><h1>Head &amp; {n}</h1>{body}<div class="comments"><p>First!</p></div></article><footer>&copy; {n}</footer></body></html>"""


def text(page, host=None):
    return x.main_text(page, host)


def test_article_without_the_rest():
    page = ARTICLE.format(n=1, body="<p>One  <b>two</b>\n three</p><p>a&lt;b<br>c<aside>x</aside><p>d<form>f</form><ul><li>i<li>j</ul>")
    assert text(page) == "Head & 1\n\nOne two three\n\na<b c\n\nd\n\ni\n\nj"


@pytest.mark.parametrize("page", [None, "", "<p>", "<", "<!-- x", "<script>x", "&amp", "<div class='nav'>a</div>"])
def test_degenerate_pages(page):
    assert text(page) in ("", "<", "&")


def test_no_mark_takes_the_densest_part():
    page = "<body><div id='header'>Top</div><div class='wrap'><div class='menu'><a>x</a></div><div class='post'><p>Long text of some words here.</p><p>More text.</p></div></div><div id=footer>End</div></body>"
    assert text(page) == "Long text of some words here.\n\nMore text."


def fold(pages):
    whole = None
    for p in pages:
        e = x.expression(x.parse(p))
        whole = e if whole is None else x.merge(whole, e)
    return whole


def test_expression_has_repeats_options_and_slots():
    e = fold(["<body><h1>A</h1><p>x</p><p>y</p><b>z</b></body>", "<body><h1>A</h1><h2>s</h2><p>q</p></body>"])
    assert x.written(e) == "#root(body(h1(=) h2(=)? p(#)+ =?))" or x.written(e).startswith("#root(body(h1(=) h2(=)? p(#)+")
    assert x.written(fold(["<dl><dt>a<dd>b<dt>c<dd>d</dl>"])) == "#root(dl((dt(#) dd(#))+))"


def test_template_texts_go_without_a_mark():
    pages = [f"<body><div><p>Always here</p><p class=x>Story {k} of many words</p></div></body>" for k in range(4)]
    d = x.decide(fold(pages), 4)
    assert text(pages[2], d) == "Story 2 of many words"
    assert "Always here" in text(pages[2], x.decide(fold(pages[:2]), 2))


def random_page(r, depth=4):
    """Blocks at random, some texts that all pages have."""

    def block(d):
        tag = r.choice(["div", "p", "ul", "h2", "section"])
        if tag in ("p", "h2") or not d:
            return f"<{tag}>{r.choice(['Same', 'Text %d' % r.randrange(99)])}</{tag}>"
        if tag == "ul":
            return "<ul>" + "<li>i</li>" * r.randrange(4) + "</ul>"
        return f"<{tag} class={r.choice('ab')}>" + "".join(block(d - 1) for _ in range(r.randrange(5))) + f"</{tag}>"

    return "<body>" + "".join(block(depth) for _ in range(4)) + "</body>"


def site(r, n):
    hosts = ["big.example"] * 3 + ["a.example", "B.example:80"]
    rows = []
    for i in range(n):
        body = "".join(f"<p>para {i} {k} &eacute;</p>" for k in range(r.randrange(0, 4)))
        rows.append((i, f"https://{r.choice(hosts)}/p/{i}?q#f", ARTICLE.format(n=i, body=body)))
    return rows


@pytest.mark.parametrize("small", [0, 10_000_000])
def test_tables(spark, monkeypatch, small):
    monkeypatch.setattr(x, "SMALL_BYTES", small)
    rows = site(random.Random(3), 60) + [(100, None, "<article>a</article>"), (101, "no url", None), (102, "http://a.example/", ""), (None, "http://a.example/", "<article>z</article>"), (100, None, "<article>a</article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_pages int").repartition(5)
    found = [tuple(r) for r in x.extract(df).collect()]
    want = [(i, u, text(h) if h else "") for i, u, h in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert x.extract(df.limit(0)).count() == 0


def test_wrappers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(site(random.Random(4), 40), "page_id long, url string, html string")
    whole = lambda d: {(r.host, r.n_pages, r.expression, bytes(r.slots)) for r in x.wrappers(d).collect()}
    assert whole(df.repartition(1)) == whole(df.repartition(6)) == whole(df.orderBy("html").coalesce(2))
    mixed = [(k, f"http://h.example/{k}", random_page(random.Random(k))) for k in range(60)]
    twice = spark.createDataFrame(mixed * 2, "page_id long, url string, html string")
    assert whole(twice.repartition(1)) == whole(twice.repartition(5)) == whole(twice.orderBy("html"))
    read = lambda d: {(r.host, r.n_pages) for r in x.wrappers(d).collect()}
    assert read(df.repartition(1)) == read(df.repartition(6))
    assert {h for h, _ in read(df)} == {"big.example", "a.example", "b.example:80"}


def test_long_unlike_lists_align():
    a = "".join(f"<div class=k{chr(97 + k % 26)}{chr(97 + k // 26)}>x</div>" for k in range(600))
    assert x.align(x.expression(x.parse(a)).kids, x.expression(x.parse(a + "<p>y</p>")).kids)[-1].times == "?"


@pytest.mark.parametrize("block", ["<blockquote>Said once</blockquote>", "<h2>Said once</h2>", "<p class=lead>Said once</p>", "<section><div><pre>Said once</pre></div></section>"])
def test_a_block_of_one_page_stays(block):
    pages = [f"<body><div><p>Always here</p>{block if k == 2 else ''}<p class=x>Story {k}</p></div></body>" for k in range(5)]
    for order in (pages, pages[::-1]):
        d = x.decide(fold(order), 5)
        assert text(pages[2], d) == "Said once\n\nStory 2"
        assert text(pages[1], d) == "Story 1"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='page with-sidebar'>{}</body>",
        "<body class='sidebar'>{}</body>",
        "<div id='page' class='no-comments'>{}</div>",
        "<div class='search-open'>{}</div>",
        "<section class='social-science'>{}</section>",
        "<div class='widget'><div class='nav'><a href=x>Menu</a></div>{}</div>",
        "<form id='page'>{}</form>",
    ],
)
@pytest.mark.parametrize("inner", ["<article><p>The text</p></article>", "<div><p>The text</p></div>"])
def test_wrappers_keep_the_article(page, inner):
    assert text(page.format(inner)) == "The text"


@pytest.mark.parametrize("name", ["comment-list", "site_header", "cookie-banner", "nav-bar", "sidebar-left", "x ad-slot", "related-posts", "menu-item"])
def test_names_of_several_words(name):
    page = "<body><div class='{}'><p>Not it</p></div><div class=post><p>The text</p></div></body>"
    assert text(page.format(name)) == "The text"


@pytest.mark.parametrize("name", ["entry-header", "post-footer", "no-comments", "social-science", "content-sidebar", "download", "headers"])
def test_names_that_only_hold_such_words(name):
    assert text(f"<body><div class='{name}'><p>One</p></div><div class=post><p>Two</p></div></body>") == "One\n\nTwo"


def test_boilerplate_still_goes():
    assert text("<body><div class='comments'><article>A long comment on it</article></div><article>Short</article><div class='x sidebar'><p>s</p></div></body>") == "Short"
    assert text("<body><header><p>A very long header of the site</p></header><p>Short</p></body>") == "Short"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><main><h1>T</h1><p>lead</p><article>The greater part of the text</article><p>the rest</p></main></body>", ["T", "lead", "The greater part of the text", "the rest"]),
        ("<body><h1>Title</h1><p>Lead</p><div class=post><p>The greater part of all of the text of this page</p></div></body>", ["Title", "Lead", "The greater part of all of the text of this page"]),
        ("<body><div><p>a</p><div><p>Many words here, and many more</p><p>b</p></div></div></body>", ["a", "Many words here, and many more", "b"]),
        ("<body><article class=one>Part one is long</article><div><article class=two>two</article></div></body>", ["Part one is long", "two"]),
        ("<body><ul><li><a href=x>Home</a></li></ul><div><p>Text</p><p><a href=y>linked</a></p></div></body>", ["Text", "linked"]),
    ],
)
def test_nothing_of_the_article_is_left_out(page, want):
    assert text(page) == "\n\n".join(want)


def test_a_page_built_otherwise_keeps_its_text():
    pages = [f"<body><main><article><p>Story {k}</p></article></main></body>" for k in range(4)] + ["<body><main><p>Outside</p><article><p>In</p></article></main></body>"]
    assert text(pages[4], x.decide(fold(pages), 5)) == "Outside\n\nIn"


def longest(p, q):
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    r = random.Random(2)
    for n in range(300):
        p, q = ([r.choice("abcdefgh"[: 2 + n % 7]) for _ in range(r.randrange(40))] for _ in range(2))
        pairs = x.common_subsequence(p, q)
        assert all(p[i] == q[j] for i, j in pairs) and len(pairs) == longest(p, q)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def pattern(e):
    """The expression as a regular expression over a page's tags and texts."""
    times = "" if e.times == "1" else e.times
    inner = "".join(map(pattern, e.kids))
    return "T" + times if e.key == "#" else f"(?:{inner}){times}" if e.key == "()" else f"(?:<{re.escape(e.key)}>{inner}</>){times}"


def tokens(node):
    if isinstance(node, x.Text):
        return "T" if node.words else ""
    return f"<{node.key}>" + "".join(map(tokens, node.kids)) + "</>"


def test_wrappers_accept_their_pages():
    for seed in range(25):
        pages = [random_page(random.Random(100 * seed + k), 3) for k in range(5)]
        whole = re.compile(pattern(fold(pages)))
        for p in pages:
            tree = x.parse(p)
            own = re.compile(pattern(x.expression(tree)))
            assert own.fullmatch(tokens(tree)) and whole.fullmatch(tokens(tree))


def test_parts_of_expressions():
    for seed in range(30):
        e = x.expression(x.parse(random_page(random.Random(seed))))
        back = x.unpacked(*x.packed(e))
        assert x.written(back) == x.written(e) and [k.shape for k in x.preorder(back)] == [k.shape for k in x.preorder(e)]
        text, values = x.packed(e)
        both = x.packed(x.merge(e, back))
        assert both[0] == text and both[1].tolist() == x.added(values, values).tolist()


class Plain(HTMLParser):
    """The blocks of <article>, without those named; by the standard library's parser."""

    SKIP = ("nav", "aside", "form", "footer", "header", "script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.skipped, self.divs = [[]], 0, 0, []

    def handle_starttag(self, tag, attrs):
        names = set((dict(attrs).get("class") or "").split())
        if tag == "article":
            self.inside += 1
        if tag in self.SKIP:
            self.skipped += 1
        if tag == "div":
            self.divs.append(bool(names & {"ad", "comments", "comment", "sidebar"}))
            self.skipped += self.divs[-1]
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag in x.BLOCK:
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag in x.BLOCK:
            self.blocks.append([])
        if tag in self.SKIP:
            self.skipped -= 1
        if tag == "div" and self.divs:
            self.skipped -= self.divs.pop()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1].append(data)


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return "\n\n".join(b for b in (" ".join("".join(b).split()) for b in p.blocks) if b)


def test_pages_equal_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in x.extract(pages).collect()} == want and len(want) > 200


def strip_marks(page):
    """The page without elements or classes that say what they are."""
    for tag in ("nav", "article", "footer"):
        page = re.sub(f"<(/?){tag}>", r"<\1div>", page)
    return re.sub(' class="(ad|comments)"', "", page)


UNMARKED = """<html><body><div><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></div><p>Read the terms of use.</p>
<section><h1>Story {k}</h1>{body}</section><p>All rights reserved by this site.</p></body></html>"""


def test_wrappers_find_the_template_of_unmarked_hosts(spark):
    r = random.Random(6)
    rows, want = [], {}
    for k in range(40):
        body = [f"Paragraph {k} {j} with some words of its own" for j in range(r.randrange(1, 5))]
        rows.append((k, f"http://u.example/{k}", UNMARKED.format(k=k, body="".join(f"<p>{t}</p>" for t in body))))
        want[k] = "\n\n".join([f"Story {k}", *body])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {p.page_id: p.text for p in x.extract(df).collect()} == want
    # without the wrapper, the notices beside the story can't be told from it
    assert all(text(h) != want[k] for k, _, h in rows)


def test_template_among_its_like():
    pages = [f"<body><div><p>Always here</p><p>Story {k} of many words</p><p>More of {k} and this</p></div></body>" for k in range(4)]
    d = x.decide(fold(pages), 4)
    assert [text(p, d) for p in pages] == [f"Story {k} of many words\n\nMore of {k} and this" for k in range(4)]


def test_copies_of_one_page_keep_their_text():
    pages = ["<body><div><p>The same text</p><p>on each page</p></div></body>"] * 5
    assert text(pages[0], x.decide(fold(pages), 5)) == "The same text\n\non each page"


def test_unmarked_test_pages(spark):
    """The given pages without their marks: of hosts with three pages or more, menus go as template, and no paragraph is lost."""
    pages = [(r.page_id, r.url, strip_marks(r.html)) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    found = {r.page_id: r.text for r in x.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, h in pages:
        for block in re.findall("<p>([^<]+)</p>", h):
            assert " ".join(x.unescape(block).split()) in found[i]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "text",
        "<section>" * 5_000 + "text" + "</section>" * 5_000,
        "<b " * 350_000,
        '<a x="' * 150_000,
        "<!--" * 200_000,
        "<svg>" * 150_000,
        "<ul><li>" + "<blockquote>" * 5_000 + "<li></li>" * 50_000,
        "<div>" * 5_000 + "</p></x>" * 100_000,
        "".join(f"<div class=k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>x</div>" for k in range(15_000)),
        "<h2>x</h2><p>y</p>" * 20_000,
    ],
)
def test_deep_and_long_pages(page):
    began = time.time()
    a, b = (x.expression(x.parse(p)) for p in (page, "<p>z</p>" + page[: len(page) // 2]))
    e = x.unpacked(*x.packed(x.merge(a, b)))
    text(page, x.decide(e, 2))
    x.written(e)
    assert time.time() - began < 20


def test_deep_page_in_a_table(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<div>" * 5000 + "deep"), (2, "http://a.example/2", "<b " * 100_000)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in x.extract(df).collect()} == {1: "deep", 2: ""}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("p1", "http://a.example/", "<p>a</p>"), (None, None, "<p>b</p>")], "page_id string, url string, html string")
    assert {r.page_id: r.text for r in x.extract(df).collect()} == {"p1": "a", None: "b"}
