"""Pages whose text stands in nested or several containers."""

from __future__ import annotations

import time

import pytest

from brinewatch.llm import html

NESTED = "<body><div class='tag'>slogan</div><article><h1>Title</h1><p>lead</p><div class='body'>{}</div><div class='more'>{}</div></article></body>"


def test_an_article_goes_before_its_parts(spark):
    rows = [(i, "http://a.com/", NESTED.format("long words " * 20, "the end")) for i in range(3)] + [(3, "http://a.com/", "<body><article></article><div class='x'>own text</div></body>")]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Title lead " + "long words " * 20 + "the end"
    assert got[3] == "own text"


def test_sibling_containers_of_other_classes_stay():
    page = "<body><div class='post'><div class='one'>{}</div><div class='two'>{}</div><div class='three'>{}</div></div></body>".format("a b " * 40, "c d " * 15, "e f " * 15)
    found = html.blocks(page)
    assert html.text_at(found, html.best_path(found)) == " ".join(("a b " * 40 + "c d " * 15 + "e f " * 15).split())


def text_of(page):
    found = html.blocks(page)
    return html.text_at(found, html.best_path(found))


BODY = "<body><nav><a href='/x'>Menu</a></nav><article>{}</article><div class='comments'><p>nice</p></div><footer>foot</footer></body>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<h1>T</h1><div title="hidden gems"><p>deep words here</p></div>', "T deep words here"),
        ('<div class="article-header"><h1>The title</h1></div><p>some words</p>', "The title some words"),
        ('<p>one</p><p class="share-price">two</p><p class="share">no</p>', "one two"),
        ('<p>one</p><div class="article-comments">no</div><div class="ad-box">no</div><div id="cookieNotice">no</div><p>two</p>', "one two"),
        ('<p>one</p><div aria-hidden="true">no</div><div hidden>no</div><p>two</p>', "one two"),
        ("<p>one <a title=it's href='/x'>link</a> it's</p><p>two</p>", "one link it's two"),
        ("<p>1 < 2 &amp; 3</p><script>if (a<b) x='</p>'</script><!-- <p>no</p> --><p>two</p>", "1 < 2 & 3 two"),
        ('<p>a<br>b</p><img alt="x > y"><p>c</p>', "a b c"),
    ],
)
def test_what_stays_and_what_goes(inner, text):
    assert text_of(BODY.format(inner)) == text


@pytest.mark.parametrize("piece", ["<a", "<div>", "<!", "<!-- ", "<script", "</p>", "<div>x", "<p class='", '<p class="', "<ul><li>x", "< ", "<div></p>"])
def test_time_is_proportional_to_the_page(piece):
    def seconds(n):
        began = time.process_time()
        text_of(piece * n + "'")
        return time.process_time() - began

    small, large = seconds(20_000), seconds(80_000)
    assert large < 8 * small + 0.2  # 16 times where it is quadratic


def test_very_long_pages_and_awkward_rows(spark):
    word = "w" * 3_000_000
    rows = [(1, "http://a.com/", f"<body><article><p>{word}</p></article></body>", "x"), (2, None, None, "x"), (None, "", "", None), (3, "http://a.com/", "no tags", "x"), (3, "http://a.com/", "no tags", "x")]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, word, 3_000_000), (2, "", 0), (3, "no tags", 7), (3, "no tags", 7)]


LONG = "<h1>The title</h1><p>" + "Words of the article. " * 26 + "</p>"
PLAIN = "The title " + ("Words of the article. " * 26).strip()
AROUND = "<body><nav><a href='/x'>Menu</a></nav>{}<div class='sidebar'><p>Other things to see here.</p></div><div class='comments'><p>nice</p></div><footer>foot</footer></body>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page has-sidebar"><article>{}</article></div>',
        '<div class="content no-sidebar">{}</div><div class="short"><p>short one</p></div>',
        '<div id="wrapper" class="layout-sidebar-left"><div class="text">{}</div></div>',
        '<div class="search-engines">{}</div>',
        '<form id="aspnetForm"><input name="state"><article>{}</article></form>',
        '<form id="aspnetForm"><input name="state"><div class="text">{}</div></form>',
        '<div class="cookie-policy"><main>{}</main></div>',
        '<div class="widgets menu-open"><section>{}</section></div>',
        '<div class="search"><article class="post sponsored">{}</article></div>',
        '<article>{}</article><div class="related-posts"><article><h3>Other</h3><p>a card of another page</p></article></div>',
    ],
)
def test_marked_wrappers_keep_the_whole_article(page):
    assert text_of(AROUND.format(page.format(LONG))) == PLAIN


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<p>one</p><div class="related-work"><p>two</p></div>', "one two"),
        ('<p>one</p><ul class="social-policy"><li>two</li></ul>', "one two"),
        ('<p>one</p><table class="menu-prices"><tr><td>two</td></tr></table>', "one two"),
        ("<header><h1>Title</h1></header><p>one</p>", "Title one"),
        ('<p>one</p><form class="signup"><label>Mail</label><input name="m"><button>Go</button></form><p>two</p>', "one two"),
        ('<p>one</p><div class="related-posts"><p>no</p></div><div class="social-share-buttons">no</div><section id="comments"><article class="comment-body"><p>no</p></article></section>', "one"),
    ],
)
def test_parts_of_an_article(inner, text):
    assert text_of(BODY.format(inner)) == text


def test_probed_pages_through_the_operator(spark):
    rows = [(i, "http://a.com/", AROUND.format(f'<div class="page has-sidebar"><article>{LONG}</article></div>')) for i in range(10)]
    assert [(r.text, r.n_chars) for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [(PLAIN, len(PLAIN))] * 10
