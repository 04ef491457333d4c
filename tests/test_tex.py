"""TeX trees and layout, HTML, offsets and comparisons on small and odd input."""

import random

import pytest

from glyphlake.operators.compare import lcs_length
from glyphlake.render.html import highlighted, html_of
from glyphlake.tex.layout import layout
from glyphlake.tex.nodes import Malformed, tree, unicode_tokens, walk

ODD = ["{", "}", "x^", r"\frac{1}", "&", r"\begin{a}", r"\left(", r"\nosuch", "x^2^3", r"\begin{matrix}a\end{cases}", r"\sqrt["]


@pytest.mark.parametrize("body", ODD)
def test_malformed_bodies_say_where(body):
    with pytest.raises(Malformed) as error:
        tree(body)
    assert 0 <= error.value.start <= error.value.end <= len(body)


@pytest.mark.parametrize("body", ["", " ", "a", r"\frac{a}{\frac{b}{c}}", r"\begin{pmatrix}1 & \frac{a}{b} \\ x\end{pmatrix}", r"\binom{n}{k}", r"\left\{ x \right.", "^2", r"\bar{ab}"])
def test_grids_are_rectangles(body):
    from glyphlake.functions.text import width_of

    g = layout(body)
    assert 0 <= g.base < len(g.lines) and len({width_of(x) for x in g.lines}) == 1
    assert all(0 <= n.start <= n.end <= len(body) for n, _ in walk(tree(body)))


def test_unicode_tokens_cover_the_text():
    for text in ("", "α²≤x₁₀ √y", "a b"):
        tokens = unicode_tokens(text)
        assert [t[1] for t in tokens[1:]] == [t[2] for t in tokens[:-1]] and (not text or tokens[-1][2] == len(text))


def test_common_lines_against_the_plain_program():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert lcs_length(a, b) == rows[-1][-1]


@pytest.mark.parametrize(
    ("text", "html"),
    [("", ""), ("a\\*b &amp; &copy;", "<p>a*b &amp; ©</p>\n"), ("![a *b*](</x y> 't')", '<p><img src="/x y" alt="a b" title="t" /></p>\n'), ("1. a\n\n   b", "<ol>\n<li>\n<p>a</p>\n<p>b</p>\n</li>\n</ol>\n"), ("<x@y.z>", '<p><a href="mailto:x@y.z">x@y.z</a></p>\n'), ("    <b>", "<pre><code>&lt;b&gt;\n</code></pre>\n")],
)
def test_html(text, html):
    assert html_of(text) == html


def test_highlighting_only_adds_colours():
    import re

    html = '<p class="a">x &lt; <!-- c --></p>'
    assert re.sub("\x1b\\[[0-9]+m", "", highlighted(html)) == html
