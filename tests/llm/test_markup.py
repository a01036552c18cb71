"""What markup says of an element, and what it only seems to say."""

import pytest

from turnlake.llm.html_text import described, main_text


@pytest.mark.parametrize("tag", [
    'p title="a class=menu b"', 'p data-role="navigation"', 'div data-id="comment-3"', 'div data-class=menu', 'p title=\'x id="footer"\'',
    'section class="search-results-study"', 'div id="footer-notes"', 'h2 id="reply-to-critics"', 'h3 id="comments"', 'p data-hidden', 'p aria-label="hidden"', 'div class="no-comments"',
])
def test_main_text_stays(tag):
    name = tag.split()[0]
    assert main_text(f"<body><article><p>first</p><{tag}>kept text</{name}></article></body>", {}) == "first\nkept text"


@pytest.mark.parametrize("tag", [
    'div class="menu"', "div class=menu", 'div CLASS = "x ad"', 'div id=comments', 'div id="comment-3"', 'div role="navigation"', "p hidden", 'p aria-hidden="true"',
    'div class="ad-slot"', 'div title="a > b" class="sidebar"', "div data-x='class=\"y\"' class='newsletter-box'",
])
def test_named_elements_go(tag):
    name = tag.split()[0]
    assert main_text(f"<body><article><p>first</p><{tag}>gone</{name}></article></body>", {}) == "first"


def test_outside_articles_single_words_count():
    assert described("div", ' class="site-wide-search-box"', False)[1] < 1 and described("div", ' class="site-wide-search-box"', True)[1] == 1
    assert main_text('<body><div id="footer-notes">gone</div><div>kept</div></body>', {}) == "kept"
