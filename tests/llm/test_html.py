from __future__ import annotations

import time

import pytest

from clientpulse.llm import html_text
from clientpulse.llm.html_text import page_table, page_texts, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>var t='</p>'</script>", ""),
        ("<p>One<p>Two <b>bo</b>ld", "One\n\nTwo bold"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td>aaa<td>b<td>d</table>", "wide    c\naaa  b  d"),
        ("a<span hidden>no</span><i style='display: none'>no</i><div style='visibility:hidden'>no</div>b", "ab"),
        ("<pre>  x\n   y</pre>", "  x\n   y"),
        ("x<br>y &amp; z&nbsp;!", "x\ny & z\xa0!"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<<b>1 < 2</b>", "<1 < 2"),
        ("a<!-- > -->b<!doctype html>c", "abc"),
        ("<img alt='a cat'> sat", "a cat sat"),
        ("<head><title>T</title><body>x", "x"),
    ],
)
def test_layout(page, text):
    assert render(page or "") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><colgroup><col><tr><td>x</table>", "x"),
        ("<table><colgroup><col><tbody><tr><td>x<td>y</table>z", "x  y\n\nz"),
        ("<table><caption>c<colgroup><col><td>x</table>", "c\nx"),
        ("<table><colgroup>loose<tr><td>x</table>", "loose\nx"),
        ("<table><td>x<td>y</table>", "x  y"),
        ("<table><tbody><td>x<tr><td>y</table>", "x\ny"),
        ("<table><tbody>loose<tr><td>x</table>", "loose\nx"),
        ("<table><tbody><p>loose</p><tr><td>x</table>", "loose\nx"),
        ("<table><tbody><form><tr><td>x<td>y</form></table>", "x  y"),
        ("<table><tr><form><td>x<td>y<tr><td>aa<td>b</form></table>", "x   y\naa  b"),
        ("<table><tbody><center><tr><td>x</center></table>", "x"),
        ("<table><tbody hidden>no<tr><td>no</tbody><tr><td>x</table>", "x"),
        ("<table><tr><td>x<template><tr><td>no</template>y</table>", "xy"),
        ("<table><tr><td><table><td>in</table><td>x</table>", "in  x"),
    ],
)
def test_tables_keep_all_their_text(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>T</title><h1>Hi</h1><p>text", "Hi\n\ntext"),
        ("<html><head><meta charset=utf-8>\n<link rel=x>\n<script>s</script>text", "text"),
        ("<head><title>T</title>\n<noscript><link></noscript><style>s</style><template>t</template></head>x", "x"),
        ("<head><title>T</title><div>a</div></head><body>b", "a\nb"),
        ("<body>a<head>b", "ab"),
        ("<html>\n<head>\n<body>x", "x"),
    ],
)
def test_head_ends_where_its_content_does(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", "so x=2."),
        ("<math><semantics><mrow><mi>y</mi></mrow><annotation>no</annotation></semantics></math>", "y"),
        ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"),
        ("<p><math><mtext><b>if</b></mtext><mi>z</math>!", "ifz!"),
        ("<svg><title>no</title><defs><text>no</text></defs>no<g><path d='M0'/><text>one</text><text x=1>two</text></g></svg>z", "one two z"),
        ("<svg><text><tspan x=0>a</tspan><tspan x=0 dy=9>b</tspan><![CDATA[c<d]]></text></svg>", "a bc<d"),
        ("<svg><title/><path/>" + "<path/>" * 300 + "<text>deep</text></svg>", "deep"),
        ("<p><svg><switch><foreignObject><div>html</div></foreignObject><text>no</text></switch></svg>", "html"),
        ("<svg><path><p>after</p>", "after"),
        ("<a href=x/>link</a><svg/>y", "linky"),
        ("<svg display=none><text>no</text></svg><svg width=0 height=0><text>no</text></svg>x", "x"),
        ("Day<select><option>Mon<option selected>Tue</select>!", "Day Tue !"),
        ("<select><option disabled>no<optgroup label=g><option>a &amp; b<option>c</select>", "a & b"),
        ("<select><option selected disabled hidden>Choose<option>a</select>", "Choose"),
        ("<select multiple><optgroup label=g><option>a<option label=l>b</select>z", "g\na\nl\nz"),
        ("<select><option>a</select><datalist><option>no</datalist><canvas>no</canvas><video>no</video>", "a"),
    ],
)
def test_formulas_drawings_and_lists_show_their_text(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<b>" * 300 + "a<i hidden>no</i>b", "ab"),
        ("<b>" * 300 + "a<div style='display:none'>no<div>no</div>no</div>b", "ab"),
        ("<b>" * 300 + "a<noscript>no<b>no</noscript>b", "ab"),
        ("<b>" * 300 + "<li hidden>no<li>b", "b"),
        ("<ul><li>a<i>" + "<b>" * 300 + "<ul><li>b</li></ul>c</i><li>d</ul>", None),
        ("<div hidden>no" + "<b>" * 300 + "<div>no</div>no</div>x", "x"),
        ("<b>" * 300 + "<svg><path/>no<text>label</text></svg><select><option>a<option>no</select>", "label a"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>a<td rowspan=0>bb<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  bb  c\nd      e\nf      g"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
    ],
)
def test_depth_and_rows_spanned(page, text):
    found = render(page)
    if text is None:
        assert found.split("\n")[-1] == "- d" and [w for w in found.split() if w != "-"] == list("abcd")
    else:
        assert found == text


def test_deep_and_broken_pages_end():
    assert render("<div>" * 5000 + "deep") == "deep"
    assert render("<td>" * 50 + "</table></p>x<").endswith("x<")
    assert len(render("<p>word " * 20_000).split()) == 20_000


def test_pages_table(spark):
    rows = [(1, "u", "<p>a", "x"), (None, None, None, "y"), (1, "u", "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in page_texts(pages).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert sorted((r.n_chars, r.n_lines) for r in page_table(pages).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("broken", ["<a ", '<a "', "<a<a", "<a '\"", '"<a \'>', '<a x="', "<!--", '<a"b '])
@pytest.mark.parametrize("tail", ["", ">", "\">"])
def test_long_broken_pages_take_linear_time(broken, tail):
    def seconds(size):
        start = time.process_time()
        html_text.render(broken * (size // len(broken)) + tail)
        return time.process_time() - start

    assert seconds(1_000_000) < 20


def test_tokens_end_outside_of_quotes():
    page = "a <b title='x>y' alt=\">\">bold</b> 1 < 2 <p <i>in</i> <u class=\"open>text"
    found, at = [], 0
    tokens = html_text.Tokens(page)
    while token := tokens.following(at):
        at = token[1]
        found.append((page[token[0] : at], token[2], token[3]))
    assert found == [
        ("<b title='x>y' alt=\">\">", False, "b"),
        ("</b>", True, "b"),
        ("<p <i>", False, "p"),
        ("</i>", True, "i"),
    ]
