"""Main text: the tables' pages against their own article markup, and hand-made pages."""

import html
import os
import re

import pytest
from fleetlens.llm.html_text import extract_main_text, main_text

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|ul|li|blockquote)>", article)
        plain = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert r.text == "\n".join(x for x in plain if x)
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><script>var a = "</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><div class="menu"><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></div>
<div id="cookie-notice">We use cookies, many, many.</div><form><p>Search, please, here.</p></form>
<div class="post"><h2>Head &amp; line</h2><p>First, with <a href=x>a link</a>, and
more&nbsp;words, to count.<p>Second one, unclosed <b>bold<br>line</b>, x &lt; y.
<div class="share">Share this!</div><blockquote>Quote, inside.</blockquote><ul><li>item one</li><li>item two</li></ul></div>
<div class="comments"><p>Great, great, great, great article, thanks, really.</p></div><aside>Side, bar, text.</aside>
<footer>&copy; me, 2020</footer></body></html>"""


def test_hand_made():
    assert main_text(PAGE) == "Head & line\nFirst, with a link, and more words, to count.\nSecond one, unclosed bold line, x < y.\nQuote, inside.\nitem one\nitem two"
    assert main_text("") == "" and main_text("<p></p><div>") == "" and main_text("just text < 3") == "just text < 3"
    assert main_text("<p>one<p>two") == "one\ntwo"
    assert main_text("<div" + " a='" * 20000) == ""


def test_edges(spark):
    long = "<article>" + "<p>word, word</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, long, "z"), (3, "<p>a</p>", None)], "page_id long, html string, text string")
    got = extract_main_text(df).orderBy("page_id", "n_chars").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (3, 1), (3, 50_000 * 11 - 1)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_names_do_not_drop_what_holds_the_article():
    one, two = "First, of many words, " * 5 + "end.", "Second, of few, words."
    for name in ("layout with-sidebar", "no-comments", "has-header", "social-enabled", "sidebar", "header"):
        for inner in (f"<article><p>{one}</p><p>{two}</p></article>", f"<div><p>{one}</p><p>{two}</p></div>"):
            page = f'<body><div class="{name}">{inner}<div class="comments"><p>Nice, nice.</p></div></div></body>'
            assert main_text(page) == f"{one}\n{two}"
    page = f'<body><article><p>{two}</p></article><div class="comments"><article><p>{one}</p></article></div></body>'
    assert main_text(page) == two


def test_short_siblings_and_link_lists_inside_the_article():
    one, two = "One, two, three, four, five and more.", "Six, seven, and eight."
    assert main_text(f"<body><div><p>{one}</p></div><div><p>{two}</p></div></body>") == f"{one}\n{two}"
    links = "<ul>" + "".join(f"<li><a href={i}>Reference {i}</a></li>" for i in range(4)) + "</ul>"
    want = f"{one}\n{two}\n" + "\n".join(f"Reference {i}" for i in range(4))
    for tag in ("article", "div"):
        assert main_text(f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Shop</a></ul><{tag}><p>{one}</p><p>{two}</p>{links}</{tag}></body>") == want


def test_headings_of_the_article_s_own_header():
    one = "First, of many words, " * 5 + "end."
    for page in (
        f'<body><header><h1>Site</h1></header><article><header><h1>Title</h1><nav><h2>no</h2></nav><p>By me, today, at home.</p></header><p>{one}</p></article></body>',
        f'<body><div class="post"><div class="entry-header"><h1>Title</h1></div><p>{one}</p></div></body>',
        f'<main><header class="top"><h1>Title</h1></header><p>{one}</p></main>',
    ):
        assert main_text(page) == f"Title\n{one}"


def test_everyday_names_on_wrappers():
    one, two = "First, of many words, " * 5 + "end.", "Second, " * 20
    for name in ("no-sidebar", "comments-open", "header-fixed", "social-share-enabled", "notice-of-appeal"):
        assert main_text(f'<body><div class="{name}"><p>{one}</p><p>{two}</p></div></body>') == f"{one}\n{two.strip()}"


ONE, TWO = "First, of many words, " * 5 + "end.", "Second, of a few, words."
LINKS = "<a href=1>Home</a> <a href=2>A</a>"
BOTH = f"{ONE}\n{TWO}"
P = f"<p>{ONE}</p><p>{TWO}</p>"
NICE = "<p>Nice, nice, very nice, I think.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # no container of the article's own, comments and menus beside it
        (f'<body><div id=top>{LINKS}</div>{P}<div class="comment-body">{NICE}</div><div class="user-comments">{NICE}</div></body>', BOTH),
        (f"<body><div id=top>{LINKS}</div><h1>Title</h1>{P}<div>{LINKS}</div></body>", f"Title\n{BOTH}"),
        (f"<body><p>{LINKS}</p>{P}<p>{LINKS}</p></body>", BOTH),
        (f'<body>{P}<ul class="comment-thread"><li>{NICE}</ul></body>', BOTH),
        (f'<body>{P}<section id="reader-comments">{NICE}</section></body>', BOTH),
        # short sections are part of the article
        (f"<body><div><section>{P}</section><section><h2>More</h2><p>Short end.</p></section></div></body>", f"{BOTH}\nMore\nShort end."),
        (f"<body><section>{P}</section><section><p>Short end.</p></section></body>", f"{BOTH}\nShort end."),
        (f'<body><div class="part">{P}</div><div class="part"><p>Short end.</p></div></body>', f"{BOTH}\nShort end."),
        (f"<body><div><h2>One</h2>{P}</div><div><h2>Two</h2><p>Short end.</p></div></body>", f"One\n{BOTH}\nTwo\nShort end."),
        (f"<body><div><h2>One</h2><section>{P}</section><h2>Two</h2><section><p>Short end.</p></section></div></body>", f"One\n{BOTH}\nTwo\nShort end."),
        (f"<body><section>{P}</section><section>{LINKS}</section></body>", BOTH),
        # parts of an article that are not its text
        (f'<body><article>{P}<div class="cta-box"><p>Join, now, please.</p></div><div class="post-footer"><p>By me, today.</p></div></article></body>', BOTH),
        (f'<body><div class="post">{P}<div class="post-share">{LINKS}</div><div class="entry-comments">{NICE}</div></div></body>', BOTH),
        (f'<body><article>{P}<div class="newsletter-form"><p>Sign up, please, here.</p></div></article></body>', BOTH),
        (f'<body><main>{P}<div class="related-posts"><p>Other, things, to read.</p></div></main></body>', BOTH),
        # and parts that are
        (f'<body><div class="post"><div class="post-header"><h1>Title</h1></div>{P}</div></body>', f"Title\n{BOTH}"),
        (f'<body><div class="story-body">{P}</div></body>', BOTH),
        (f'<body><div class="text-block">{P}</div></body>', BOTH),
        (f'<body><article><div class="notice-of-appeal"><p>{ONE}</p></div><p>{TWO}</p></article></body>', BOTH),
        (f"<body><div>{P}<p><a href=x>Source</a></p></div></body>", f"{BOTH}\nSource"),
        (f"<body><div><p>{ONE}</p><table><tr><td>Cell, one<td>Cell, two</table><p>{TWO}</p></div></body>", f"{ONE}\nCell, one\nCell, two\n{TWO}"),
        (f"<body><nav>{LINKS}</nav><div><div><div>{P}</div></div></div><div><p>&copy; 2020</p></div></body>", BOTH),
        (f'<body><div class="wrap"><div class="content">{P}</div><div class="sidebar-right">{NICE}</div></div></body>', BOTH),
        (f"<body><dl><dt>Term, here<dd>{ONE}<dt>Other<dd>{TWO}</dl></body>", f"Term, here\n{ONE}\nOther\n{TWO}"),
    ],
)
def test_shapes(page, want):
    assert main_text(page) == want


def test_hostile_nesting_takes_linear_time():
    import time

    one = "First, of many words, " * 5 + "end."
    began = time.process_time()
    for page in ("<b>" * 100_000 + one, "<div>" * 100_000 + one, "<b>" * 50_000 + "</i>" * 50_000 + one, "<p><table>" + "<b>" * 50_000 + "<p></p>" * 50_000 + one, "<b>" * 50_000 + "<li>x" * 50_000 + one, "<div>x" * 50_000 + one, "<a href=x>y" * 50_000 + one):
        assert one in main_text(page)
    assert time.process_time() - began < 20
