"""Main text by place: zones that nest, equal text that is article, form without telling names."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from heddle.llm.html_extract import Wrapper, bounded, merge, page_form


def texts(pages):
    """Of the pages of one host."""
    wrapper = None
    for html in pages:
        own = page_form(html)
        wrapper = own if wrapper is None else bounded(merge(wrapper, own))
    tool = Wrapper(wrapper)
    return [tool.text(html) for html in pages]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><h1>Report {i}</h1><blockquote>Lead that all reports share.</blockquote><p>Result {i} differs.</p></div>", "Report {i} Lead that all reports share. Result {i} differs."),
        ("<article><h1>Report {i}</h1><p>Same lead</p><p>Result {i}</p><p>Same end</p></article>", "Report {i} Same lead Result {i} Same end"),
        ("<div><p>Same first</p><p>Own {i}</p><div><p>Same in the middle</p></div><p>More {i}</p></div>", "Same first Own {i} Same in the middle More {i}"),
        ("<main><h2>T {i}</h2><table><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>{i}</td></tr></table><ul><li>same</li></ul></main>", "T {i} Name Value a {i} same"),
    ],
)
def test_equal_running_text_stays_on_any_number_of_pages(page, text):
    for n in (1, 2, 3, 6):
        assert texts([page.format(i=i) for i in range(n)]) == [text.format(i=i) for i in range(n)]


def test_zones_nest():
    cases = {
        "<main><h1>Title</h1><article><p>Body</p></article><p>Tail of the article</p></main>": "Title Body Tail of the article",
        "<h1>Title</h1><div><p>intro</p></div><div class=content><p>rest</p></div>": "Title intro rest",
        "<div id=story><p>Long story text</p></div><main><p>x</p></main>": "Long story text x",
        "<div class=content><div><p>around</p></div><article><p>Body</p></article></div>": "Body",
        "<div><p>Teaser</p></div><article><p>A body of some length</p></article><div class=entry><p>Other</p></div>": "A body of some length",
        "<div class=content><p>Old</p></div><div><p>After</p></div>": "Old",
    }
    assert {page: texts([page])[0] for page in cases} == cases


def test_names_inside_an_article():
    kept = ["<div class=alert-level>{x}</div>", "<div class=comment-free>{x}</div>", "<div class=form-factor>{x}</div>", "<div id=banner-making>{x}</div>", "<div id=community-notice>{x}</div>", "<div class='notice-period'>{x}</div>"]
    gone = ["<div class='reader-comments'>{x}</div>", "<div class=sidebar-left>{x}</div>", "<div id=footer>{x}</div>", "<div class='cookie-banner wide'>{x}</div>", "<div id=comments-list>{x}</div>"]
    for zone in ("article", "main"):
        for part, there in [*((p, True) for p in kept), *((p, False) for p in gone)]:
            page = f"<{zone}><p>Start</p>{part.format(x='Middle')}<p>End</p></{zone}>"
            assert texts([page]) == ["Start Middle End" if there else "Start End"], page
        assert texts([f"<{zone}><p>A</p><div class=post-header><h2>Sub</h2>by me</div><p>B</p></{zone}>"]) == ["A Sub B"]


def test_lists_of_links():
    refs = "<h1>T {i}</h1><p>Refs of the article:</p><ul><li><a href=x>Smith 200{i}</a></li><li><a href=y>Jones 199{i}</a></li></ul><ul><li><a href=/>Home</a></li><li><a href=/shop>Shop</a></li></ul>"
    assert texts([refs.format(i=1)]) == ["T 1 Refs of the article: Smith 2001 Jones 1991 Home Shop"]  # undecided: stays
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/shop>Shop</a></li></ul>"
    page = "<div><h1>T {i}</h1><p>Refs:</p><ul><li><a href=x>Smith 200{i}</a></li></ul></div><div class=q9>" + menu + "</div>"
    assert texts([page.format(i=i) for i in range(4)]) == [f"T {i} Refs: Smith 200{i}" for i in range(4)]
    assert texts([menu + "<p>Body</p>"]) == ["Body"]


PLANTED = """<article><div>Three minutes of reading</div><h1>Head {i}</h1><div class=q1><a href=a>Share</a> <a href=b>Mail</a></div><p>Body {i}</p>
<p>We thank our readers.</p><div class=q2><p>Get our letter each week</p></div></article>"""


def test_form_without_names_inside_an_article():
    """The wrapper finds what stands around the text, or is a row of links; and it changes every page of such a host."""
    many = texts([PLANTED.format(i=i) for i in range(5)])
    assert many == [f"Head {i} Body {i} We thank our readers." for i in range(5)]
    alone = [texts([PLANTED.format(i=i)])[0] for i in range(5)]
    assert alone == [f"Three minutes of reading Head {i} Share Mail Body {i} We thank our readers. Get our letter each week" for i in range(5)]


def test_numbered_classes_are_told_apart():
    page = "<div class=box1>Menu words</div><div class=box2><p>Body {i}</p></div><div class=box3>Imprint</div>"
    assert texts([page.format(i=i) for i in range(3)]) == [f"Body {i}" for i in range(3)]
    # long numbers count things
    many = "".join(f"<div class=item-{1000 + k}><p>Text {k} {{i}}</p></div>" for k in range(5))
    assert texts([many.format(i=i) for i in range(3)]) == [" ".join(f"Text {k} {i}" for k in range(5)) for i in range(3)]


def test_copies_of_one_page_keep_their_text():
    page = "<article><div>Intro</div><p>Body</p></article>"
    assert texts([page] * 4) == ["Intro Body"] * 4
