import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tracewright.llm import html_text as h

CASES = [
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<p>a\n  b<p>c<div>d</div>e", "a b\n\nc\n\nd\ne"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>';</script>y", "xy"),
    ("<title>t</title><meta charset=u>x", "x"),
    ("a<br>b<br><br>c<hr>d", "a\nb\n\nc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "* a\n* b\n  * c\n* d"),
    ("<ol start=9><li>a<p>b<li value=20>c<li>d</ol>", "9. a\n\n   b\n20. c\n21. d"),
    ("<dl><dt>t<dd>one<dd>two<dt>u</dl>", "t\n    one\n    two\nu"),
    ("<b hidden>x</b><i style='Display : NONE'>y</i><u style='visibility:hidden'>z<s style=visibility:visible>w</s></u>", "w"),
    ("<details>more<summary>s</summary><p>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>wide cell<td>f</table>", "a  b  c\n   d  e\nwide cell  f"),
    ("x<table>stray<tr><td>1<table><tr><td>in</table><td>2</table>y", "xstray\n\n1   2\n\nin\n\ny"),
    ("<td>no table</td>", "no table"),
    ("<pre>\n a\n   b\n</pre>c", " a\n   b\n\nc"),
    ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("<!-- c --><!doctype html><?php ?>a<!-- open", "a"),
    ("1 < 2 <3 a<b c='>'>d</b><a href=\"un>closed>e", "1 < 2 <3 adclosed>e"),
    ("<select><option>a<option>b</select><textarea>\n<b> x</textarea>", "a\nb\n<b> x"),
    ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
    ("</p>a</br>b</div></li>", "a\nb"),
    ("<noscript>n</noscript><template>t</template><svg><text>s</text></svg>v", "n sv"),
    ("a<span> </span>b <i> c</i>", "a b c"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_layout(html, want):
    got = h.render(html)
    assert got == want


def test_cut_tags():
    assert h.render("a<b") == "a" and h.render("<" * 50_000 + " x").endswith("x")


def test_deep_and_long_pages_stay_fast():
    assert h.render("<ul><li>" * 3000 + "x").strip().endswith("x")
    assert h.render("<div>" * 5000 + "x") == "x"
    assert len(h.render("<table>" + "<tr><td>" + "a" * 100_000 + "<td>b" * 1 + "<tr><td>c<td>d" * 2000 + "</table>")) < 2_000_000
    assert h.render("<a b='" * 2000 + "x") == ""


class Words(HTMLParser):
    """Independent reading of what is visible, without layout: words in any order."""

    HIDE = {"script", "style", "head", "template", "title", "noembed", "iframe", "svg"}

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []  # (tag, hidden)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "body":
            self.open = [x for x in self.open if x[0] != "head"]
        gone = tag in self.HIDE or "hidden" in a or bool(re.search(r"(display:\s*none|visibility:\s*hidden)", a.get("style") or ""))
        if tag not in h.VOID:
            self.open.append((tag, gone or any(x[1] for x in self.open)))
        elif tag == "input" and not any(x[1] for x in self.open):
            self.handle_data(a.get("value") or a.get("placeholder") or "")

    def handle_endtag(self, tag):
        at = [i for i, x in enumerate(self.open) if x[0] == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if not any(x[1] for x in self.open):
            self.out += re.findall(r"\w+", data)


def test_given_pages_have_exactly_the_visible_words(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    got = {r["page_id"]: r for r in h.op10_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        w = Words()
        w.feed(page)
        w.close()
        mine = re.findall(r"\w+", re.sub(r"(?m)^ *\d+\. ", "", got[i]["text"]))
        assert sorted(mine) == sorted(w.out), (i, set(mine) ^ set(w.out))


VISIBLE = [
    ("<svg><title>t</title><g><text>one</text><text x=1>two<tspan>three</tspan></text></g><circle/>noise<foreignObject><p>html</p></foreignObject></svg>after", "one twothree\n\nhtml\n\nafter"),
    ("a <input value='go' type=submit> b <input type=hidden value=x><input placeholder=name><input type=password value=p>c", "a go b name c"),
    ("<style>.h{display:none} #x, b.k {visibility : hidden}/* .c{display:none} */ @media print{.p{display:none}} .c .d{display:none}</style><p class='a h'>no</p><p id=x>no<i style='visibility:visible'>yes</i></p><b class=k>no</b><b>b</b> <i class=p>p</i> <u class=d>d</u> <s class=h style='display:block'>s</s>", "yes\n\nb p d s"),
    ("<svg><style/><text>q</text></svg><p>r", "q\n\nr"),
    ("<svg><b>out</b>x", "outx"),
    ("<style>p{display:none}p{display:block}</style><p>seen", "seen"),
]


@pytest.mark.parametrize("html,want", VISIBLE)
def test_drawings_fields_and_style_sheets(html, want):
    assert h.render(html) == want


def test_ties_repeats_and_other_columns(spark):
    rows = [(1, "<p>a", "u")] * 3 + [(1, "<p>b", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in h.extract_text(df).collect()) == [(1, "a")] * 3 + [(1, "b")]


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (2, "", None)], "page_id long, html string, text string")
    assert sorted(map(str, h.extract_text(df).collect())) == sorted(["Row(page_id=1, text=None, n_lines=None, n_chars=None)", "Row(page_id=None, text='a', n_lines=1, n_chars=1)", "Row(page_id=2, text='', n_lines=0, n_chars=0)"])
    assert h.extract_text(df.where("false")).count() == 0


@pytest.mark.parametrize("part", ["<div>", "<ul><li>a", "<p><b>", "<dl><dd>q", "<svg><g>", "<button><p>a", "<table><tr><td>a", "<style>.a{display:none}</style><p class=b>a"])
def test_open_elements_cost_the_same_however_many_there_are(part):
    def took(n):
        began = time.process_time()
        h.render(part * n)
        return time.process_time() - began

    small, large = min(took(2_000) for _ in range(3)), took(20_000)
    assert large < 30 * max(small, 0.01)


def test_two_hundred_thousand_open_elements():
    began = time.process_time()
    text = h.render("<div>" * 200_000 + "x")
    assert text == "x" and time.process_time() - began < 4


def test_deeply_nested_tables_keep_their_text():
    got = h.render("".join(f"<table><tr><td>c{i}" for i in range(300)))
    assert re.findall(r"c\d+", got) == [f"c{i}" for i in range(300)]
