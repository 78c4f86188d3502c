"""Text-to-tag ratios choose the regions; markup of any kind is survived."""

import pytest

from latticework.llm.html_text import main_text

LONG = "A paragraph of the text that is long enough to be told from the rest of the page by its ratio."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<![foo[x]]>b", "ab"),
        ("<![CDATA[x]]> y <![", "y <!["),
        ('<article><p class="notice">cookie text<p>real article text stands here.</article>', "real article text stands here."),
        ("<article><ul><li class='menu'>menu<li>first point<li>second point</ul></article>", "first point\nsecond point"),
        (f"<body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{LONG}<p>{LONG}</body>", f"{LONG}\n{LONG}"),
        (f"<div><nav><a>One</a></div><div><p>{LONG}</p></div>", LONG),
        ("<article>x &lt;b&gt; &eacute;<script>if (a<b) '</p>'</script> y</article>", "x <b> é\ny"),
        ("<article><p>cut off in the mid<", "cut off in the mid<"),
        ("<nav>only a menu</nav><footer>and a footer</footer>", ""),
        ("<main><h1>Title</h1><p>Body.</p><div class='comments'><p>first!</p></div></main>", "Title\nBody."),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


def test_ratios_choose_without_named_elements():
    links = "".join(f"<div><a href=/{k}>entry {k}</a></div>" for k in range(6))
    page = f"<div>{links}</div><div><h1>Title</h1></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><p>Imprint</p></div>"
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"
    # With the threshold off every line is content, and the boilerplate comes along.
    assert "entry 3" in main_text(page, lambda v: -1.0) and "Imprint" in main_text(page, lambda v: -1.0)


def test_ratios_choose_among_articles():
    teasers = "".join(f"<article><a href=/{k}>teaser {k}</a></article>" for k in range(4))
    page = f"<article><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></article>{teasers}"
    assert main_text(page) == f"Title\n{LONG}\n{LONG}"
    assert "teaser 1" in main_text(page, lambda v: -1.0)


def test_a_menu_inside_the_article():
    items = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(5))
    page = f"<article><p>{LONG}</p><p>{LONG}</p><ul>{items}</ul><p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG}\n{LONG}\n{LONG}"
    assert "link 2" in main_text(page, lambda v: -1.0)


def test_a_very_long_page_and_repeated_rows(spark):
    from latticework.llm import html_text

    page = "<nav><a>menu</a></nav><article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(30_000)) + "</article>"
    frame = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, "<p>x")], "page_id long, url string, html string")
    got = html_text.extract(frame).collect()
    assert sorted(r.n_chars for r in got) == [1, *[len(main_text(page))] * 2] and main_text(page).count("\n") == 29_999


def test_deep_nesting():
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
