"""Parser, formatter, TeX and edits on small texts: positions, laws and odd input."""

import pytest
from pyspark.sql import functions as F

from glyphlake.fmt.engine import format_range, format_text, signature, stable
from glyphlake.functions import text as T
from glyphlake.operators.facts import canonical, lines_of, parse_facts
from glyphlake.parse.facts import parse
from glyphlake.rules.run import diagnostics, fixed, select
from glyphlake.sources import config, corpus
from glyphlake.tex.translate import to_latex, to_unicode

ODD = ["", "\n", "   ", "```\nnever closed", "---\nno end", "é 漢 😀 *a*", "> > - a\n> >   b\n\nc", "# \n## \n", "| a |\n|---|\n", "[a]: \n", "\\( {x", "a\tb\n\tcode\n", "1. x\n1. y\n\n   z\n", "*" * 200, "> " * 60 + "deep"]
CASES = [*ODD, "# T.\n\nSee http://x.org. and *a* $5\n\n| a|b |\n|---|---|\n| 1 | 2|\n", "- a\n- b\n\n  c\n* d\n", "A [l](/u \"t\") and `c`\nline two  \nthree\n", "---\ntitle: x\n---\n\n# H {#id .c k=v}\n", "\\begin{align}\na &= b \\\\\ncc &= d\n\\end{align}\n"]
SHAPES = [config.Fmt(), config.Fmt(wrap=20), config.Fmt(italic="underscore", strong="underscore", list_marker="plus"), config.Fmt(tables_style="align", ordered_list="one", thematic_break="underscore-70")]


@pytest.mark.parametrize("text", CASES)
def test_facts_lie_inside_the_text(text):
    for rows in parse(text).facts.values():
        assert all(0 <= f["s"] <= f["e"] <= len(text.encode()) for f in rows)


@pytest.mark.parametrize("o", SHAPES)
@pytest.mark.parametrize("text", CASES)
def test_formatting_keeps_the_meaning_and_settles(text, o):
    once, _ = format_text(text, o)
    assert signature(once, False) == signature(text, False)
    assert format_text(once, o)[0] == once
    assert stable(text, o)


def test_default_options_touch_tables_and_line_ends_only():
    text = "*a*   __b__\r\n\r\n***\r\n1. x\r\n5. y\r\n"
    assert format_text(text)[0] == text.replace("\r\n", "\n")


def test_a_range_formats_the_blocks_it_touches():
    text = "one\n\n| a|b |\n|---|---|\n| 1|2 |\n\nend\n"
    start, end, new = format_range(text, 8, 9)
    assert text[start:end].startswith("| a|b |") and new.startswith("| a | b |")


def test_positions_are_bytes(spark):
    docs = spark.createDataFrame([(1, "é `x`\n"), (2, None), (3, ""), (None, "`y`")], "doc_id long, text string")
    found = parse_facts(docs, ["inline_codes"]).select("doc_id", "s", "e").collect()
    assert sorted((r.doc_id or 0, r.s, r.e) for r in found) == [(0, 0, 3), (1, 3, 6)]


def test_lines_of_odd_texts(spark):
    texts = ["", "a", "a\n", "é\r\nb\rc\0", "\n\n", "x\n" * 3000 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", canonical().alias("text"))
    got = {}
    for r in lines_of(docs).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append((r.s, r.e, r.text))
    for k, text in enumerate(texts):
        text, want, at = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd"), [], 0
        for line in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
            want.append((at, at + len(line.encode()), line))
            at += len(line.encode()) + 1
        assert got.get(k, []) == want


def test_findings_fixes_and_suppression(spark):
    docs = spark.createDataFrame(
        [(1, "See http://x.org. now\n\nIt is $5.\n"), (2, "<!-- lint: disable stray-dollar -->\n\nIt is $5.\n"), (3, None), (4, "# A.\n")], "doc_id long, text string"
    )
    rules = select("none,+bare-url,+stray-dollar,+heading-punctuation")
    found = diagnostics(docs, rules, share=False)
    assert sorted((r.doc_id, r.rule, r.line, r.col) for r in found.collect()) == [(1, "bare-url", 1, 5), (1, "stray-dollar", 3, 7), (4, "heading-punctuation", 1, 4)]
    after = {r.doc_id: r.text for r in fixed(docs.select("doc_id", canonical().alias("text")), found).collect()}
    assert after[1].startswith("See <http://x.org>. now") and after[2].endswith("It is $5.\n") and after[3] is None


def test_overlapping_edits_are_taken_from_the_end(spark):
    rows = spark.createDataFrame([("abcdef", [(0, 1, 3, "X"), (2, 2, 5, "Y"), (5, 3, 5, "!")])], "text string, edits array<struct<s int, ord int, e int, r string>>")
    kept = T.greedy_from_the_end(F.col("edits"))
    assert rows.select(T.splice(F.col("text"), kept).alias("t")).first().t == "abY!f"


TO_UNICODE = [
    (r"\alpha_i + x^{2} \to \beta", "αᵢ + x² → β", "lossless"), (r"\bar{Y'}", "{Y'}̅", "lossless"), (r"\alphabeta + \color{red}{x}", r"\alphabeta + \color{red}{x}", "lossy"),
    (r"\frac{a}{b} + \sqrt[n]{x}", r"\frac{a}{b} + ⁿ√x", "lossy"), (r"\le", "≤", "lossy"), ("", "", "unchanged"), (r"\sin x", "sin x", "lossless"), (r"x_{ab}^2 \in \mathbb{R}", "x_{ab}^2 ∈ ℝ", "lossy"),
    (r"\left( \alpha \right)", "( α )", "lossless"), (r"\begin{a} x & y \end{a}", r"\begin{a} x & y \end{a}", "lossy"),
]
TO_LATEX = [
    ("αᵢ ≤ x² → β", r"\alpha_{i} \leq x^{2} \to \beta"), ("{Y'}̅", r"\bar{Y'}"), ("√x", r"\sqrt{x}"), ("ⁿ√x", r"\sqrt[n]{x}"), ("√x²", r"\sqrt{x^{2}}"), (r"\frac{a}{b}", r"\frac{a}{b}"),
    (r"x_{n} + \color{red}{x}", r"x_{n} + \color{red}{x}"), (r"\mathrm{Div}^+_X", r"\mathrm{Div}^{+}_{X}"), ("M_[φ]", r"M_{\phi}"), ("x^(n)", "x^{n}"), ("A′", "A'"), ("𝔭′", r"\mathfrak{p}'"), ("A″", "A''"), ("", ""),
]


@pytest.mark.parametrize(("tex", "plain", "status"), TO_UNICODE)
def test_tex_to_unicode(tex, plain, status):
    assert (to_unicode(tex).text, to_unicode(tex).status) == (plain, status)


@pytest.mark.parametrize(("plain", "tex"), TO_LATEX)
def test_unicode_to_tex(plain, tex):
    assert to_latex(plain).text == tex


def test_odd_tex_is_kept_with_its_losses():
    for body in ("{", "}", "x^", "\\nosuch{x}", "\\frac{1}", "&", "x_{", "\\begin{a}", "\\sqrt[", "\\left("):
        assert (to_unicode(body).text, to_unicode(body).status) == (body, "lossy")
    for body in ("\\", "^", "_", "{", "√", "x̅", "²", "{}̅", "^{"):
        to_unicode(body), to_latex(body)


def test_configuration_is_strict():
    assert config.load("[lint]\nignore = ['bare-url']\n").lint.ignore == ["bare-url"]
    assert config.load(config.default_toml()) == config.Config()
    with pytest.raises(ValueError):
        config.load("[lint]\nnosuch = 1\n")


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.md", "a/b.md", True), ("/a.md", "b/a.md", False), ("docs/", "docs/x.md", True), ("a/**/z.md", "a/b/c/z.md", True), ("a?.md", "ab.md", True), ("[ab].md", "c.md", False)])
def test_exclude_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(corpus.excluded(F.lit(path), [pattern]).alias("x")).first().x is hit


def test_scan_finds_markdown_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.md", "sub/b.markdown", "c.txt", "skip.md"):
        (tmp_path / name).write_text(name)
    (tmp_path / ".gitignore").write_text("skip.md\n")
    files = corpus.scan(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(r.text for r in files.collect()) == ["a.md", "sub/b.markdown"]


def test_size_and_control_characters_are_checked(spark):
    docs = spark.createDataFrame([(1, "ok\n"), (2, "x" * 50), (3, "a\x07b"), (4, "tab\tok")], "doc_id long, text string")
    good, bad = corpus.admitted(docs, limit=20)
    assert (sorted(r.doc_id for r in good.collect()), sorted(r.doc_id for r in bad.collect())) == ([1, 4], [2, 3])


def test_similarity_and_width():
    assert T.jaro_winkler("", "") in (0.0, 1.0) and T.jaro_winkler("abc", "abc") == 1.0 and T.jaro_winkler("abc", "xyz") == 0.0
    assert [T.width_of(x) for x in ("a漢", "e\u0301", "", None)] == [3, 1, 0, None]
