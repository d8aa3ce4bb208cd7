"""op8: templates that a site gives away, pages without an article, names that mislead."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from nichefold.llm import html_text

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt labore magna aliqua".split()


def prose(rng, n=25):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def site(seed=0, host="https://Site.example"):
    """Pages without article or telling names: a menu, a box within the text, an advert, one of 3 sections' lists; their own paragraphs."""
    rng = random.Random(seed)
    menu = "<div><span>Home</span> <span>About us</span> <span>Everything else we have ever written about</span></div>"
    box = "<section>Sign up for our letter and never miss a thing</section>"
    rows = []
    for i in range(30):
        mine = [prose(rng) for _ in range(3)]
        listing = f"<ul><li>Section {i % 3}</li><li>has news</li></ul>"
        body = f"<p>{mine[0]}</p>{box}<p>{mine[1]}</p>" + (f"<div>{mine[2]}</div>" if i % 2 else f"<p>{mine[2]}</p>")
        rows.append((i, f"{host}/p/{i}", f"<html><head><title>t</title></head><body>{menu}{listing}<div id=c{i}>{body}</div><div>Imprint and terms</div></body></html>", "\n".join(mine)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(frame(spark, rows)).collect()}


def test_templates_decide(spark):
    rows = site()
    assert extracted(spark, rows) == {r[0]: r[3] for r in rows}
    without = {r[0]: html_text.main_text(r[2]) for r in rows}
    assert all("Home" in without[i] and "letter" in without[i] and "Imprint" in without[i] for i in without)


def test_templates_equal_brute_force(spark):
    """Recurring subtrees a host, counted without Spark: pages of different prose that hold the hash."""
    rows = site(1) + [(100 + i, "https://other.example/x", h, w) for i, _, h, w in site(2)[:4]] + [(200 + i, "https://site.example/copy", site(1)[0][2], "") for i in range(9)]
    holders, pages = defaultdict(set), defaultdict(set)
    for _, url, source, _ in rows:
        host = url.split("/")[2].lower()
        order = html_text.in_order(html_text.parse(source))
        found = html_text.hash_subtrees(order)
        text = "|".join("".join(c for c in n.children if isinstance(c, str)) for n in order if n.tag == "p")
        pages[host].add(text)
        for h in found:
            holders[host, h].add(text)
    want = defaultdict(set)
    for (host, h), texts in holders.items():
        if len(texts) >= html_text.MIN_PAGES and len(texts) >= html_text.MIN_SHARE * len(pages[host]):
            want[host].add(h)
    got = {r.host: set(r.hashes) for r in html_text.templates(frame(spark, rows)).collect()}
    assert got == dict(want)
    assert len(got["site.example"]) == 6  # menu, three lists, box, imprint


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div>Menu of {0}</div><article><h1>T</h1><div>{1}</div></article></body>"
    rng = random.Random(3)
    text = prose(rng)
    rows = [(i, "https://h.example/", page.format(i, f"<p>{text}</p>"), f"T\n{text}") for i in range(40)]
    assert extracted(spark, rows) == {r[0]: r[3] for r in rows}


def test_templates_within_articles(spark):
    rng = random.Random(4)
    rows = []
    for i in range(20):
        a, b = prose(rng), prose(rng)
        rows.append((i, "https://h.example/", f"<article><p>{a}</p><div class='entry'><div>Read our letter</div></div><p>{b}</p><ul><li>same list</li></ul></article>", f"{a}\n{b}\nsame list"))
    assert extracted(spark, rows) == {r[0]: r[3] for r in rows}
    assert "letter" in html_text.main_text(rows[0][2])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<article><div class="entry comments-open"><p>real body text</p></div></article>', "real body text"),
        ('<body><div class="content has-sidebar"><p>real text</p></div></body>', "real text"),
        ('<article><div id="search-results-methods"><p>how we searched</p></div></article>', "how we searched"),
        ('<article><p class="ad-free">kept</p><p>the <span class="social">social</span> life</p></article>', "kept\nthe social life"),
        ('<body><div class="content-sidebar-wrap"><p>text of the page</p><div class="sidebar">side</div></div></body>', "text of the page"),
        ('<article><h1>T</h1><p>one two three</p><div class="comment-list"><p>nice</p></div><div class="related-posts">more</div><div id="siteFooter">c</div></article>', "T\none two three"),
        ('<body><form id="aspnetForm"><div><p>whole page in a form</p></div></form></body>', "whole page in a form"),
        ('<body><div class="notice"><p>a page that is a notice</p></div></body>', "a page that is a notice"),
        ('<body><nav><article>teaser</article></nav><div><p>the text that matters here</p></div></body>', "the text that matters here"),
        ('<body><main><p>main text of it all</p></main><div>tail</div></body>', "main text of it all"),
        ('<article><p>a first part</p></article><hr><article><p>and a second</p></article>', "a first part\nand a second"),
        ("<div>" * 3000 + "<article>deep</article>", "deep"),
        ('<article><p>first part</p><section class="related"><h2>Related work</h2><p>Others have done this.</p></section></article>', "first part\nRelated work\nOthers have done this."),
        ('<article><p>we ate there</p><div id="menu"><h2>Menu</h2><p>Soup, then <a href="/f">fish</a>.</p></div><p>and left</p></article>', "we ate there\nMenu\nSoup, then fish.\nand left"),
        ('<article><p>a b c d e f g</p><div class="alert"><p>Mind the step.</p></div><div id="share"><p>Each has a share.</p></div></article>', "a b c d e f g\nMind the step.\nEach has a share."),
        ('<article><p>a b c d e f g h</p><div class="related"><p><a href="/x">Another page</a></p></div><div class="advert"><p>Buy it.</p></div></article>', "a b c d e f g h"),
        ('<article><header><h1>Head</h1></header><p>text</p><footer>by me</footer></article>', "Head\ntext"),
    ],
)
def test_names_that_mislead(source, want):
    assert html_text.main_text(source) == want


def test_repeated_sections_with_paragraphs_go(spark):
    rng = random.Random(9)
    rows = []
    for i in range(12):
        a = prose(rng)
        rows.append((i, "https://k.example/", f"<article><p>{a}</p><div class='alert'><p>We are closed on Mondays.</p></div></article>", a))
    assert extracted(spark, rows) == {r[0]: r[3] for r in rows}
    assert "Mondays" in html_text.main_text(rows[0][2])


def test_text_column_that_is_there(spark):
    df = spark.createDataFrame([(1, "https://h/", "<p>x</p>", "mine")], "page_id long, url string, html string, text string")
    r = html_text.extract(df).first()
    assert (r.text, r.text_1) == ("mine", "x")
