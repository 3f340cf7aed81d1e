import re
import time
from html.parser import HTMLParser

import pytest

from tesserine.llm import html_text, queries

from ..conftest import SMALL


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("<table><tr><th colspan=2>top<tr><td>a<td>b</table>", "top\na  b"),
    ("<style>x</style><script>a<b</script>t<!-- c -->u", "tu"), ("<p hidden>no</p>yes<div style='display:none'>no<p>no</div>", "yes"), ("<div aria-hidden=true>no</div>a", "a"),
    ("<title>no</title><body>b", "b"), ("<pre>a\n  b</pre>", "a\n  b"), ("a  \n b<b> c</b>d", "a b cd"), ("<h1>t</h1>x<hr>y", "t\n\nx\n\ny"), ("<img alt='pic'>!", "pic!"), ("<template><p>no</template>y", "y"),
    ("<a title='x>y'>l</a>", "l"), ("1 < 2 <3", "1 < 2 <3"), ("<b><p>x</b>y</p>z", "xy\n\nz"), ("&lt;p&gt;", "<p>"), ("<textarea>no</textarea><select><option>no</select>k", "k"),
])
def test_layout(source, want):
    assert html_text.render(source) == want


@pytest.mark.parametrize(("source", "want"), [
    ("<p title='the hidden gem'>a</p>", "a"), ('<div class="nav hidden md:flex">a</div>', "a"), ("<p title='style=\"display:none\"'>a</p>", "a"), ("<p data-x=1 HIDDEN>no</p>a", "a"), ("<p style=display:none>no</p>a", "a"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>a</text><text>b</text></svg>c", "a bc"), ("<select><option>no<option selected>a</select>", "a"), ("x<xmp><b>a</xmp>y", "x\n\n<b>a\n\ny"),
])
def test_visible_text_stays(source, want):
    assert html_text.render(source) == want


def test_deep_and_broken_pages_take_linear_time():
    for page in ("<div>" * 20000 + "x", "<p><b>" * 20000, "<table><tr><td>" * 800 + "x", "<a '" * 5000, "<li>" * 20000, "&" * 50000, "<!--" * 5000, "</p>" * 20000):
        began = time.time()
        html_text.render(page)
        assert time.time() - began < 10


def test_every_page_gives_its_visible_words(spark):
    rows = queries.op8_html_text(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "<script" not in r.text for r in rows)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "c"), (None, None, "<p>a", "c"), (1, "u", None, "c"), (2, "u", "<p>" + "word " * 100000, "c")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.n_chars, r.n_lines) for r in html_text.extract(pages).collect()) == [(0, 1, 1), (1, 0, 0), (1, 0, 0), (2, 499999, 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ("<div aria-hidden=true>shown</div>a", "shown\na"), ("<textarea>one\ntwo &amp;</textarea>k", "one\ntwo &\n\nk"),
    ("<select><option>first<option>no</select>k", "first k"), ("<select><option>no<option selected>second<option>no</select>k", "second k"), ("<select multiple><option>a<option>b</select>", "a b"), ("<select><option>a</select><select><option>b<option selected>c</select>", "a c"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>shown</p>no</div>a", "shown\n\na"), ("<p style='color:red;display : none'>no</p>a", "a"), ("<p data-style='display:none'>shown</p>", "shown"), ("<p class='a hidden b' data-hidden>a</p>", "a"),
    ("<img alt=pic style='visibility:hidden'>x", "x"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td colspan=1>f</table>", "a  b  c\nd     e\nf"),
    ("<a title=\"x>text</a> b", "text b"), ("<p title='x>text</p>", "text"), ("<p class=it's>it's</p>", "it's"), ("<a href=x/>a</a>", "a"), ("<details><summary>s</summary>d</details>", "s\nd"),
])
def test_what_the_screen_shows(source, want):
    assert html_text.render(source, assistive=False) == want


class Slow(HTMLParser):
    """Lines of visible words, from the standard library's parser: blocks and rows
    begin lines, list items have their marker, cells follow on."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.lines, self.skip, self.lists, self.marker = [[]], 0, [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "template"):
            self.skip += 1
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag in html_text.BLOCK - {"td", "th"} or tag in ("br", "hr"):
            self.lines.append([])
        if tag == "li" and not self.skip:
            self.lists[-1][1] += 1
            self.marker = ["-" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "template"):
            self.skip -= 1
        if tag in ("ul", "ol"):
            self.lists.pop()
        if tag in html_text.BLOCK - {"td", "th"}:
            self.lines.append([])
            self.marker = [] if tag == "li" else self.marker

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.lines[-1] += self.marker
            self.marker = []
            self.lines[-1].append(data)


def test_every_page_equals_an_independent_rendering(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = queries.op8_html_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    tight = lambda lines: [t for x in lines if (t := re.sub(r"\s+", "", x))]
    for r in rows:
        assert tight(r.text.split("\n")) == tight(map("".join, Slow(pages[r.page_id]).lines))


def test_very_long_page_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "<table>" + "<tr><td>a<td>b" * 30000 + "</table>")], "page_id long, html string")
    assert html_text.extract(pages).first().n_lines == 30000
    assert html_text.extract(pages.limit(0)).count() == 0
