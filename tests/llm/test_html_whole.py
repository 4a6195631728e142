"""Visible text that misread markup once lost."""

import pytest

from tracewright.llm import html_text as h

QUOTES = [
    ("<a title=it's>one</a> <a title=it's>two</a>", "one two"),
    ('<p class="a"">Hello</p><p class="b"">World</p>', "Hello\n\nWorld"),
    ("<a href=/x?q=\"b>one</a> <i \"c>two</i> <i d=''e'>three</i>", "one two three"),
    ("<a title = 'x>y' alt=\"p>q\"z>one</a><br/><a href=/a/b/>two</a>", "one\ntwo"),
    ("<p title=don't'hidden>kept<p title=\"hidden>kept too", "kept\n\nkept too"),
    ("<p title='a' hidden>x</p><p title=a/b hidden=''>y</p><p/hidden>z</p>seen", "seen"),
]


@pytest.mark.parametrize("html,want", QUOTES)
def test_quotes_open_values_only_after_equals(html, want):
    assert h.render(html) == want


FORMULAS = [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"),
    ("<math><semantics><mrow><mi>a</mi></mrow><annotation encoding=tex>\\a</annotation><annotation-xml encoding='text/html'><p>b</p></annotation-xml></semantics></math>c", "ac"),
    ("<math><mspace width=1em/><annotation/><mi>x</mi><mphantom><mi>y</mi></mphantom></math>z<math/>!", "xz!"),
    ("<math><annotation>t<p>kept<p/>too", "kept\n\ntoo"),
    ("<head><math/>a</head>b", "ab"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mtext>a<b>b</b></mtext></mtd></mtr></mtable></math>", "1 2\nab"),
    ("<math><maction><mi>p</mi><mi>q</mi></maction></math><annotation>html</annotation><semantics>h<b>t</b></semantics>", "phtmlht"),
    ("<table><tr><td><math><mi>x</mi></math><td>y</table>", "x  y"),
]


@pytest.mark.parametrize("html,want", FORMULAS)
def test_formulas_are_shown(html, want):
    assert h.render(html) == want
