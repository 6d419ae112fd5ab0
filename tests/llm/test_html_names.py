import pytest
from terrane.llm import html

SIDE = '<div class="sidebar-primary"><p>Side</p></div>'


def text(body: str) -> str:
    return " ".join(t for _, t, _ in html.Page(f"<html><body>{body}</body></html>").main())


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-sidebar-wrap", "page_menu_open"])
def test_wrapper_whose_name_contains_a_word(name):
    assert text(f'<div class="{name}"><article><h1>Head</h1><p>Text</p></article>{SIDE}</div>') == "Head Text"
    assert text(f'<div id="{name}"><div role="main"><p>Text</p></div>{SIDE}</div>') == "Text"
    assert text(f'<div class="{name}"><div class="content"><p>Text of a page without article</p></div>{SIDE}</div>') == "Text of a page without article"
    assert html.Page(f'<body class="{name} comment-page"><p>Text</p></body>').blocks == [(f">body.{'.'.join(sorted((name, 'comment-page')))}>p", "Text", False)]


def test_names_inside_the_article():
    assert text('<article><section id="related-work"><h2 id="search-methods">Search</h2><p>Work</p></section><div class="social-impact">Impact</div></article>') == "Search Work Impact"
    assert text('<article><h2 id="search">Search</h2><p>Text</p><div class="x ad">Buy</div><div id="comments">First!</div><div role="search">Find</div></article>') == "Search Text"
    assert text('<article id="how-to-comment-code"><p>Text</p></article><article class="comment">Reply</article>') == "Text"


def test_names_that_still_cut():
    body = '<div class="post"><p>The text of a page without article element</p></div>'
    for kind in ('class="ad"', 'class="ad-slot"', 'id="cookie_notice"', 'class="left-sidebar"', 'role="banner"'):
        assert text(f"<div {kind}><p>Other</p></div>{body}") == "The text of a page without article element"
    assert text('<p>Our <span class="ad-label">advert</span>text, long enough to be more than half</p>') == "Our text, long enough to be more than half"


def test_text_before_a_cut_inline_element_stays():
    assert text("<p>Before <script>track()</script>and after <button>Go</button>it</p><p>End <button>Open") == "Before and after it End"
