import html
import re
import time

import pytest

from blurframe.llm import html_text, queries


def test_parts_of_the_frame_go():
    for page, content in html_text.labelled_pages():
        assert set(re.findall(r"\b[cn]\d+", html_text.extract(page))) == content


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p>One &amp; two&nbsp;\n three</p><p>Four<br>five</p>", "One & two three\n\nFour five"),
        ("<nav>menu</nav><article><h1>Title</h1><p>Some <b>bold</b> text here<p>More", "Title\n\nSome bold text here\n\nMore"),
        ("<article><p>Words &lt;tag&gt; and &eacute;t&eacute; &#169;</p></article><script>var x='<p>no</p>'</script><p", "Words <tag> and été ©"),
        ("<article><p>First part of the text.</p><div class='ad banner'>buy now</div><p>Second part of the text.</p></article>", "First part of the text.\n\nSecond part of the text."),
        ("<main><p>A text with five words.</p></main><section id='comments'><p>nice</p></section><footer>foot</footer>", "A text with five words."),
        ("<!-- <p>hidden</p> --><style>p{}</style><div><p>Shown words only.</p></div>", "Shown words only."),
        ("<article><p>1 < 2 and 3 > 2 holds</p></article>", "1 < 2 and 3 > 2 holds"),
    ],
)
def test_small_pages(page, text):
    assert html_text.extract(page) == text


ARTICLE = "<h1>A title here</h1>" + "".join(f"<p>Part {i} has a good number of words in it, and goes on for a while.</p>" for i in range(5))
TEXT = "\n\n".join(["A title here", *(f"Part {i} has a good number of words in it, and goes on for a while." for i in range(5))])


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="layout has-sidebar">%s</div>',
        '<div class="content-with-sidebar"><article>%s</article></div>',
        '<div id=page class="no-comments">%s</div>',
        '<div class="post ad-free">%s</div>',
        "<form action='/'>%s</form>",
        '<div class="sidebar-layout"><main>%s</main></div>',
        '<div class="widget"><div class="popup">%s</div></div>',
        "<div>%s</div>",
    ],
)
def test_wrappers_are_no_frame(wrapper):
    """An element that holds the text is no part of the frame, whatever its name; what stands beside it is."""
    page = '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>' + wrapper % ARTICLE + '<div class="sidebar"><p>Other things to read</p></div><footer>All rights</footer></body>'
    assert html_text.extract(page) == TEXT


def test_the_scan_decides():
    """Without article elements and marks: a menu of links and a line before, links after, and comments with a mark."""
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"
    comments = "<div class='comment-list'>" + "<p>I liked this very much, thank you for it.</p>" * 12 + "</div>"
    assert html_text.extract(f"<body>{links}<div>{ARTICLE}</div>{comments}{links}</body>") == TEXT
    linked = "".join(f"<p><a href='/{i}'>A whole part of the text that is a link, number {i}, and is long.</a></p>" for i in range(4))
    assert html_text.extract(f"<nav>{links}</nav><article>{linked}</article>").count("number") == 4
    word, _ = html_text.weights()
    assert word["text"] > 0 > word["menu"] and word["frame"] < 0 and word["outside"] < 0


def test_markup_inside_a_block():
    assert html_text.extract("<article><p>Good words <span class='ad'>buy this</span> and more of them</p><svg/><p>After the drawing</p></article>") == "Good words and more of them\n\nAfter the drawing"
    assert html_text.extract("<div><p>One <b>two</i> three</p></b><p>four five six</p></div>") == "One two three\n\nfour five six"


@pytest.mark.parametrize("page", ["<div>" + "<span>" * 32000 + "</i>" * 32000, "<i><div>" + "<span>" * 32000 + "</i>" * 32000, "<p a='" * 32000, "<" * 100000, "<b><p>" * 32000])
def test_time_is_linear(page):
    began = time.perf_counter()
    html_text.extract(page + "some words")
    assert time.perf_counter() - began < 5


def test_long_page():
    page = "<nav><a href='/'>home</a></nav><article>" + "<p>many words stand here</p>" * 20_000 + "</article>"
    assert html_text.extract(page).count("\n\n") == 19_999


def test_odd_tables(spark):
    """Null pages, repeated rows, an empty table, and columns with the names of the result."""
    rows = [(1, "u", "<p>Some words here</p>", "x", "y"), (1, "u", "<p>Some words here</p>", "x", "y"), (None, None, None, None, None), (2, None, "", "t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _x string")
    out = html_text.extract_pages(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 0), (1, "Some words here", 15), (1, "Some words here", 15), (2, "", 0)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_pages_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_html_region(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
