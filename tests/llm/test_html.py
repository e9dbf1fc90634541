"""Main text of pages in the layouts that sites use, of hostile pages, and of odd tables."""

import time

import pytest

from lodestack.llm.html_text import extract_pages, main_text

PROSE = "The quick brown fox jumps over the lazy dog, and the story goes on for a while. " * 4
ARTICLE = "".join(f"<p>{k} {PROSE}</p>" for k in range(6))
WANT = "\n".join(f"{k} {PROSE}".strip() for k in range(6))
COMMENTS = "<p>I liked this very much. Thanks for writing it, and greetings from here.</p>" * 3
AROUND = [
    "comment-list", "comments-area", "comments-section", "commentlist", "discussion", "responses", "sidebar-left", "sidebar-inner", "cookie-bar", "ad-slot", "ad-container", "related-posts",
    "newsletter-box", "promo-box", "share-buttons", "popup-overlay", "footer-inner", "site-footer-widgets", "nav-links", "header-top", "topbar", "wp-comment-wrap", "notice",
]


@pytest.mark.parametrize("name", AROUND)
def test_named_boilerplate_goes(name):
    assert main_text(f"<body><nav><a>m</a></nav><article>{ARTICLE}</article><div class='{name}'>{COMMENTS}</div></body>") == WANT
    assert main_text(f"<body><div class=wrap><div>{ARTICLE}</div><div id='{name}'>{COMMENTS}</div></div></body>") == WANT
    assert main_text(f"<body><article>{ARTICLE}</article><ol class={name}><li class=comment>{COMMENTS}</li></ol></body>") == WANT


def test_names_that_only_hold_such_words():
    for name in ("has-sidebar", "post-content share-enabled", "entry-content related-box", "article-header", "loads", "shared", "menus-and-more-x"):
        assert main_text(f"<body><div class='{name}'>{ARTICLE}</div><footer>f</footer></body>") == WANT, name


def test_short_sections_stay():
    assert main_text(f"<body><main><section>{ARTICLE}</section><section><p>Short end.</p></section></main></body>") == f"{WANT}\nShort end."
    assert main_text(f"<body><main><h1>Title</h1><section>{ARTICLE}</section><section><a href=x>all</a> <a href=y>links</a></section></main></body>") == f"Title\n{WANT}"
    assert main_text(f"<body><div><section>{ARTICLE}</section><section><p>It ends here.</p></section></div></body>") == f"{WANT}\nIt ends here."


def test_forms():
    assert main_text("<body><form><p>A short article. It is here.</p></form></body>") == "A short article. It is here."
    assert main_text("<body><form><label>Name</label><input></form></body>") == ""


def test_markup():
    assert main_text("<p>a < b and 5 > 3 <!-- no --> c<![CDATA[ x > y ]]>d &lt;p&gt; <a title='>\"'>e</a>") == "a < b and 5 > 3 cd <p> e"
    assert main_text("<p>one<br>two <b class=\"unclosed>three</b> four") == "one two three four"
    assert main_text("<p>kept <![CDATA[ never closed") == "kept <![CDATA[ never closed"
    assert main_text("<p>x</p><!-- to the end <p>y</p>") == "x"


@pytest.mark.parametrize("unit", ["<![CDATA[ x ", "<a b='x\" ", "<p", '<div class="', "<!-- ", "<? ", "&lt", "</p x='", "<script>", "<title></title ", "<b><i>", "<li>", "</div>"])
def test_hostile_pages_take_time_in_proportion(unit):
    def seconds(n):
        page = "<body><p>x</p>" + unit * (n // len(unit))
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    assert seconds(400_000) < 1 + 12 * seconds(100_000)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, id long, text string, n_chars string"
    long = f"<article>{'<p>' + 'word ' * 1_000 + '</p>'}</article>" * 200
    rows = [(1, "u", "<p>a b.</p>", 3, "t", "n"), (1, "u", "<p>a b.</p>", 3, "t", "n"), (None, None, None, 3, "t", "n"), (2, "v", "", 3, "t", "n"), (3, "w", long, 3, "t", "n"), (4, "w", " \n ", 3, "t", "n")]
    d = spark.createDataFrame(rows, schema)
    got = sorted((r.page_id or 0, r.url or "", r.text[:10], r.n_chars) for r in extract_pages(d).collect())
    assert got == [(0, "", "", 0), (1, "u", "a b.", 4), (1, "u", "a b.", 4), (2, "v", "", 0), (3, "w", "word word ", 200 * 4_999 + 199), (4, "w", "", 0)]
    assert extract_pages(d.limit(0)).count() == 0
