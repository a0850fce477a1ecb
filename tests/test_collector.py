"""Elements of pages: tag soup by hand, and fuzzed pages against the standard reader of HTML."""

import random
from html.parser import HTMLParser

import pytest

from weftline.operators import collector
from weftline.operators.features import VOID

SOUP = """<!DOCTYPE html><!-- <b> --><UL class='a  b'><li id=x style="color:red; --Gap : 1px;background:url(a;b:c)">1<li class=c Role>2 < 3
<table><tr><td><p>one<p>two<td aria-label="a>b" aria-x data-k='1'>x<tr><th>y</table></ul></i>
<style>@media (max-width: 9px) { a:hover { Color: red; /* top: 0; */ margin : 0 } } b::after{content:"};left:1"}</style><img alt src=q.png /><br>
<script>if (a < b) document.write("<b>");</SCRIPT ><p>&amp;<div class="x&amp;y">z</div><div/><b class="no"""


def test_tag_soup_by_hand():
    rows = [dict(zip((c.split()[0] for c in collector.SCHEMA.split(", ")), r, strict=True)) for r in collector.elements(SOUP)]
    assert [(r["tag"], r["depth"], r["parent"]) for r in rows] == [
        ("ul", 1, None), ("li", 2, 0), ("li", 3, 0), ("table", 4, 2), ("tr", 5, 3), ("td", 6, 4), ("p", 7, 5), ("p", 8, 5), ("td", 9, 4), ("tr", 10, 3), ("th", 11, 9),
        ("style", 9, None), ("img", 9, None), ("br", 9, None), ("script", 9, None), ("p", 9, None), ("div", 10, None), ("div", 10, None),
    ]
    assert rows[0]["classes"] == ["a", "b"] and rows[2]["classes"] == ["c"] and rows[16]["classes"] == ["x&y"]
    assert rows[1]["properties"] == ["color", "--gap", "background"] and rows[1]["style"].startswith("color:red")
    assert rows[11]["properties"] == ["color", "margin", "content"] and rows[11]["style"] is None
    assert [(r["role"], r["alt"], r["aria"], r["data"]) for r in (rows[2], rows[8], rows[12])] == [(1, 0, 0, 0), (0, 0, 2, 1), (0, 1, 0, 0)]
    assert rows[14]["body"] == 'if (a < b) document.write("<b>");'


@pytest.mark.parametrize("html, n", [(None, 0), ("", 0), ("no tag < 1 <3", 0), ("<!-- <b>", 0), ("<b", 0), ("<p>" * 30_000, 30_000), ("<script>" + "x<" * 50_000, 1), ("<ul><li>" * 200, 400), ("<p><button>" + "<h1>" * 30_000 + "</x>" * 30_000, 30_002), ("İ<script>a</script><b>", 2)])
def test_edges(html, n):
    assert len(list(collector.elements(html))) == n


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.depth, self.inside = [], 0, None

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.rows.append([tag, self.depth + 1, first.get("class", "").split(), first.get("style") or None, sum(k.startswith("aria-") for k in first), ""])
        self.depth += tag not in VOID
        self.inside = tag if tag in collector.RAW else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.depth -= tag not in VOID
        self.inside = None

    def handle_endtag(self, tag):
        self.depth -= tag not in VOID and self.depth > 0
        self.inside = None

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1] += data


def test_fuzzed_pages_read_as_the_standard_reader_does():
    rng = random.Random(5)
    pieces = ["<div>", "</div>", "<p class=a>", "<p class='b  c'>", '<p class="d&lt;e" style="top:0">', "</p>", "<br>", "<br/>", "<img alt=x aria-a='1' aria-b>", "text", " ", "&amp;", "<!-- c <b> -->", "<!DOCTYPE html>",
              "<script>if (a<b) x('<i>')</script>", "<style>a{b:c}</style>", "<B Class=Q class=r>", "</b >", "<a href=x/y>", "<a href='>'>", "</x>", "<li\nstyle = 'a:b'\n>", "5 < 6 ", "<hr />"]
    for _ in range(400):
        html = "".join(rng.choices(pieces, k=rng.randint(1, 30)))
        reader = Reader()
        reader.feed(html)
        reader.close()
        got = [[r[1], r[2], r[4], r[5], r[9], r[11] or ""] for r in collector.elements(html)]
        assert got == reader.rows, html


def test_declared_at_depth():
    assert collector.declared("a:hover, b { color : red; } @media (x:1) { c:d { top:0 } e{left:1} } f:g", 0) == ["color", "top", "left"]
    assert collector.declared("a:1;b;c:2;:3;4x:5", 1) == ["a", "c"]
    assert collector.declared("x{a:1}}b:2{c:3", 0) == ["a", "c"]
    assert collector.declared('x{content:";a:1}";b:"\\"c:1;";/* d:1 */e:1', 0) == ["content", "b", "e"]


def test_rows_of_cards(spark):
    cards = spark.createDataFrame([(0, "c0", 0, 1, "<p class='a b' style='top:0'>x<br>"), (0, "c1", 1, 2, None), (0, "c2", 2, 3, ""), (0, "c0", 0, 4, "<script>fetch(1)</script><style>p{left:1}</style>")], "batch long, config string, config_ord int, slot long, html string")
    rows = collector.page_elements(cards)
    assert {(r.slot, r.pos, r.tag, r.depth) for r in rows.collect()} == {(1, 0, "p", 1), (1, 1, "br", 2), (4, 0, "script", 1), (4, 1, "style", 1)}
    assert {r.slot: (r.n, r.n_tags, r.max_depth, r.sum_depth, r.n_classes, r.n_inline, r.style_chars, r.script_chars) for r in collector.collected(rows).collect()} == {1: (2, 2, 2, 3, 2, 1, 0, 0), 4: (2, 2, 1, 2, 0, 0, 9, 8)}
    got = {(r.slot, r.token) for r in collector.feature_rows(rows, r"\b(fetch|then)\b").collect()}
    assert got == {(1, x) for x in ("tag:p", "tag:br", "class:a", "class:b", "css:top")} | {(4, x) for x in ("tag:script", "tag:style", "css:left", "jsapi:fetch")}
