from __future__ import annotations

import html

import pytest

from lexweave.llm.html_text import extract_text, visible_text
from lexweave.llm.tables import table

CASES = {
    "blocks": ("<h1>A</h1><p>one  two\n three<p>four<div>five</div>six<br>seven", "A\n\none two three\n\nfour\n\nfive\nsix\nseven"),
    "implied ends": ("<ul><li>a<li>b<p>c<li>d</ul>e", "- a\n- b\n\n  c\n\n- d\n\ne"),
    "numbers": ("<ol start=3><li>a</li><li>b<ul><li>x<li>y</ul></li></ol>", "3. a\n4. b\n   - x\n   - y"),
    "not shown": ("<head><title>T</title><style>.x{display:none} #k , b.y { color:red; display : none }</style><script>var a='</p>';</script></head><body>a<!-- c --><span hidden>h</span><i style='display: NONE'>n</i><u class='q x'>x</u><b class=y>y</b><b>z</b><noscript>s</noscript><em id=k>k</em>", "az"),
    "visibility": ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span>c</div>d", "b\nd"),
    "table": ("<table><caption>C</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>both</table>", "C\nname       n\nlong name  1\nboth"),
    "sections": ("<table><thead><tr><td>a<tbody><tr><td>b<td>c</tbody><tfoot><tr><td>d</table>x", "a\nb  c\nd\n\nx"),
    "lines in cells": ("<table><tr><td>a<br>b<td>c<tr><td>dd<td>e</table>", "a   c\nb\ndd  e"),
    "nested table": ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>z</table><tr><td>b</table>", "a  x  y\n   z\nb"),
    "pre": ("<pre>\n  a\n    b  c\n</pre>d", "  a\n    b  c\n\nd"),
    "inline spaces": ("a <b> b </b> c<i>d</i>\n<b>e</b>", "a b cd e"),
    "entities": ("&lt;p&gt; &copy; &eacute;&nbsp;x &unknown; &#x41;", "<p> © é x &unknown; A"),
    "quotes": ("<blockquote>a<p>b</blockquote>c", "> a\n\n> b\n\nc"),
    "details": ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details><dialog>no</dialog>", "s\nt\nshown"),
    "stray": ("</p>a</b></div>b<li>c", "a\n b".replace("\n ", "") + "\n- c"),
    "definitions": ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    "unclosed bold": ("<p><b>head<br><p>text</p></article>", "head\n\ntext"),
    "broken": ("<p>a < b & c <", "a < b & c <"),
    "plain": ("no markup\nat all", "no markup at all"),
    "print rules": ("<style>@media print{.nav{display:none}} @media screen and (min-width: 600px){.a{display:none}} @media (max-width:600px){.b{display:none}} @supports (x:y){.c{display:none}}</style><i class=nav>n</i><i class=a>a</i><i class=b>b</i><i class=c>c</i>", "nb"),
    "nested rules": ("<style>/* .d{display:none} */ .a{color:red; .b{display:none} margin:0} @import 'x{';.e{content:'}';display:none}</style><style media=print>.d{display:none}</style><i class=a>a</i><i class=d>d</i><i class=e>e</i>", "ad"),
    "formula": ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><msup><mi>y</mi><mn>2</mn></msup><annotation>tex</annotation></math>.", "so x=1/2y^2."),
    "drawing": ("a<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><g>no<text x=1>one <tspan>two</tspan></text><text>three</text></g></svg>b", "a one two three b"),
    "text field": ("<p>a<textarea>\nb  c\nd</textarea>e", "a\nb  c\nd\ne"),
    "options": ("a <select><option>x<option selected>y</select> b <select><option disabled>v<option>w</select><select multiple><optgroup label=G><option>p<option>q</select>", "a y b w G\np\nq"),
    "text between cells": ("<table>s<thead>h<tr><td>a</thead><tbody><tr>r<td>b</td>t<td>c</table>x", "shrt\n\na\nb  c\n\nx"),
    "rule": ("a<hr>b", "a\n\n----\n\nb"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert visible_text(page) == want


def test_deep_and_long_pages_end():
    deep = "<div>" * 30_000 + "x" + "<span><table><tr><td>" * 300 + "y"
    assert visible_text(deep).split() == ["x", "y"]
    assert len(visible_text("<p>word " * 100_000).split()) == 100_000


def test_all_text_of_the_pages_is_kept(spark, sf_dir):
    """Of given pages, whose markup is plain: the words outside of head and comments, in order."""
    import re

    rows = {r.page_id: r for r in extract_text(table(spark, sf_dir, "pages")).collect()}
    for page in table(spark, sf_dir, "pages").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", page.html)
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for w in rows[page.page_id].text.split() if w != "-"]
        assert "".join(got) == "".join(w for w in want if w != "-")


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "<p>a", 0), (None, "<p>b<p>c", 0)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, 0, 0), (2, "", 0, 0), (2, "a", 1, 1), (None, "b\n\nc", 4, 3)], key=repr)
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
