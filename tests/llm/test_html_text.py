import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import html_text
from shelfcast.llm.html_text import main_text
from shelfcast.llm.queries import op12_main_text

MENU = "<nav><ul><li><a href='/x'>menu</a></ul></nav>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<script>x", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("a < b <3 c &nbsp; d &#65;&eacute;", "a < b <3 c d Aé"),
        ("<p>x &am<b>p;</b>", "x &amp;"),
        (f"<body>{MENU}<article><h1>T</h1><p>A<p>B</article><footer>f</footer>", "T A B"),
        ("<body><header>site</header><article><header><h1>T</h1></header><p>A</article>", "T A"),
        ("<article><p>one<div class='comments'><p>said</div><form>in</form><p>two", "one two"),
        ("<article>short</article><div>much longer than the article, but beside it and without a name</div>", "short"),
        ("<article><section><p>first part</section><section><p>2</section></article>", "first part 2"),
        ("<article><p>mine<article class='comment'><p>theirs</article></article>", "mine"),
        ("<div class='with-sidebar'><article>kept</article></div>", "kept"),
        ("<div class='popup'>all there is</div>", "all there is"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>", "a b c x y"),
        ("<article>one<br>two<i>three</i></article>", "one twothree"),
        ('<article><a title="a>b">x</a> y</article>', "x y"),
        ("<article><p>t<script>var t='</p>';</script>u<!-- <p>no -->v</article>", "tuv"),
    ],
)
def test_articles(page, text):
    assert main_text(page) == text


def test_density_finds_the_article_without_article_element():
    menu = "<div><ul>" + "<li><a href=x>a menu item</a>" * 20 + "</ul></div>"
    body = "<div><p>" + "real text, " * 40 + "<p>" + "more of it. " * 30 + "</div>"
    assert main_text(f"<body>{menu}{body}<div><p>tiny</div>") == " ".join(("real text, " * 40 + "more of it. " * 30).split())


def test_densities_by_hand():
    tree = html_text.parse("<body><div>abcd<p>ef</p></div></body>")
    density, sums = html_text.densities(tree)
    at = {tag: i for i, tag in enumerate(tree.tags)}
    # No links: characters per tag. The sum of div has its own four characters and p's two.
    assert density[at["p"]] == 2 and density[at["div"]] == 6 and sums[at["div"]] == 6 and sums[at["body"]] == 6


@given(st.text(alphabet="<>/abp\"'= !-&;l\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_page_is_read(page):
    text = main_text(page)
    assert text == " ".join(text.split())


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, '<a href="' * 20_000, "<p>x</b>" * 50_000, "<!--" * 50_000):
        main_text(page)


def test_query_gives_every_article_whole(spark, tables):
    rows = {r.page_id: r for r in op12_main_text(spark, tables).collect()}
    pages = spark.read.parquet(f"{tables}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = page.html.split("<article>")[1].split("</article>")[0]
        text = " ".join(unescape(re.sub(r"<[^>]*>", " ", article.replace("<b>", ""))).split())
        assert rows[page.page_id].text == text and rows[page.page_id].n_chars == len(text) and rows[page.page_id].url == page.url


def test_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html_text.extract_text(spark.createDataFrame([], schema)).collect() == []
    long = "<article>" + "<p>word</p>" * 200_000
    rows = [(None, None, None, "t", "n"), (1, "u", "<p>x", None, None), (1, "u", "<p>x", None, None), (2, None, long, None, None)]
    found = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in found) == [(0, "", 0), (1, "u", 1), (1, "u", 1), (2, "", 999_999)]
