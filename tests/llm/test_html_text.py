import time

import pytest
from loomtext.llm.html_text import extract, main_text

CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>a  b\n c&amp;d &eacute;<p>x<br>y", "a b c&d é\nx y"),
    ("<script>var t='</p>';</script><style>p{}</style><p>One, two.</p><!-- <p>no</p> -->", "One, two."),
    ("<body><header>Site</header><div class='side-bar'><p>x, y, z</p></div><main><article><header><h1>T</h1></header><p>a, b</p><p>c<p>d<ul><li>e<li>f</ul>"
     "<div class='comments'><p>nice</p></div></article></main><footer>f</footer>", "T\na, b\nc\nd\ne\nf"),
    ("<body><nav><ul><li><a href=/x>Home</a></ul></nav><div class=ad>Buy, buy</div><div><h1>T</h1><p><b>Long, long text.<br><p>More</div><form><p>Mail</form>", "T\nLong, long text.\nMore"),
    ("<article><p>cut off in an ent&am", "cut off in an ent&am"),
    ("<body>Loose, text.<section><p>" + "Long, long. " * 30 + "</section><section><p>Short one.</section>tail", "Loose, text.\n" + ("Long, long. " * 30).strip() + "\nShort one.\ntail"),
    ("<article><p class='notice-of-death'>a<div id='share-price'>b</div><p class='cookie-notice'>c<div class='share'>d</div><p>e</article>", "a\nb\ne"),
    ("<div id='share'>x, y, z</div><div class='post site-footer'>x</div><div class='Comment-List_2'>x</div><p>One, two.</p>", "One, two."),
    ("<div>" * 3000 + "<p>deep" + "</div>" * 3000, "deep"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_unmatched_ends_take_no_time():
    began = time.process_time()
    assert main_text("<b>" * 20_000 + "</i>" * 20_000 + "text") == "text"
    assert time.process_time() - began < 3


def test_extract(spark):
    pages = spark.createDataFrame([(i, "u", p, "z") for i, (p, _) in enumerate(CASES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in extract(pages).collect()}
    assert [rows[i].text for i in range(len(CASES))] == [t for _, t in CASES]
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert extract(pages.limit(0)).count() == 0
