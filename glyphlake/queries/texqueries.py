"""TeX bodies: tokens, trees, the registry, translation of ranges, layout, and what renderers know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.operators.facts import Facts
from glyphlake.operators.fixtures import _lit
from glyphlake.queries.book import Book, document, table
from glyphlake.tex import nodes as N, registry as R
from glyphlake.tex.layout import drawn
from glyphlake.tex.render import Profile, classified, issues, overlay, package_bit, package_mask
from glyphlake.tex.translate import translate, translated_regions

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
KEY = "CAST(p_partkey AS VARCHAR)"
BACK = "chr(92)"


def bodies(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), text.alias("text"))


def chosen(options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.col("p_partkey") % len(options) + 1).cast("int"))


def case(values: list[object]) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@BOOK.add("tex01_tokens", f"SELECT {DOC}, unnest(['command', 'super', 'open', 'char', 'close', 'space', 'char']) AS kind, unnest([0, 6, 7, 8, 9, 10, 11]) AS s, unnest([6, 7, 8, 9, 10, 11, 13]) AS e FROM part")
def tex01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.tokens_of(bodies(spark, sf_dir, F.lit("\\alpha^{2} é"))).select("doc_id", "kind", "s", "e")


_TREES = {
    r"\frac{a}{b}": [("body", 0, 11), ("fraction", 0, 11), ("group", 5, 8), ("atom", 6, 7), ("group", 8, 11), ("atom", 9, 10)],
    "x^2_i": [("body", 0, 5), ("script", 0, 5), ("atom", 0, 1), ("atom", 4, 5), ("atom", 2, 3)],
    "{a": [("error", 0, 1)],
    r"\sqrt{\alpha}": [("body", 0, 13), ("root", 0, 13), ("group", 5, 13), ("symbol", 6, 12)],
}


@BOOK.add("tex02_trees", " UNION ALL ".join(f"SELECT {DOC}, '{kind}' AS kind, {s} AS s, {e} AS e FROM part WHERE p_partkey % 4 = {k}" for k, rows in enumerate(_TREES.values()) for kind, s, e in rows))
def tex02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes_of(bodies(spark, sf_dir, chosen(list(_TREES)))).select("doc_id", "kind", "s", "e")


# Names, categories and symbols that the registry has to hold.
_KNOWN = "alpha greek α, Omega greek Ω, pm operator ±, leq relation ≤, to arrow →, sum large ∑, infty symbol ∞, sin function -, frac parsed -, quad silent -, newcommand unsupported -"
_KNOWN_ROWS = [x.split(" ") for x in _KNOWN.split(", ")]


@BOOK.add("tex03_registry", " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS category, '{s}' AS symbol" for n, c, s in _KNOWN_ROWS))
def tex03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.commands(spark).where(F.col("name").isin([n for n, _, _ in _KNOWN_ROWS])).select("name", "category", F.coalesce("symbol", F.lit("-")).alias("symbol"))


@BOOK.add("tex04_symbols_both_ways", f"SELECT {DOC}, {case([repr(x) for x in ('leq', 'le', 'to', 'nosuch')])} AS name, {case([repr(x) for x in ('≤', '≤', '→', '-')])} AS symbol, {case([repr(x) for x in ('leq', 'leq', 'to', '-')])} AS back FROM part")
def tex04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, chosen(["leq", "le", "to", "nosuch"])).withColumnRenamed("text", "name")
    known = R.commands(spark)
    there = rows.join(F.broadcast(known.select("name", "symbol")), "name", "left")
    back = there.join(F.broadcast(known.where("preferred").select("symbol", F.col("name").alias("back"))), "symbol", "left")
    return back.select("doc_id", "name", F.coalesce("symbol", F.lit("-")).alias("symbol"), F.coalesce("back", F.lit("-")).alias("back"))


@BOOK.add("tex05_scripts", f"SELECT {DOC}, translate({KEY}, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS up, translate({KEY}, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS down, 'none' AS odd FROM part")
def tex05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing: a string with one character that has no script form has none."""
    key = F.col("text")
    rows = bodies(spark, sf_dir, F.col("p_partkey").cast("string"))
    return rows.select("doc_id", R.scripted(key, R.SUPER).alias("up"), R.scripted(key, R.SUB).alias("down"), F.coalesce(R.scripted(F.concat(key, F.lit("ß")), R.SUPER), F.lit("none")).alias("odd"))


@BOOK.add("tex06_alphabets", f"SELECT {DOC}, 'ℝ𝐚𝔤' AS plain, {BACK} || 'mathbb{{R}}' || {BACK} || 'mathbf{{a}}' || {BACK} || 'mathfrak{{g}}' AS back, 'sin ' || {KEY} AS word FROM part")
def tex06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, F.lit(r"\mathbb{R}\mathbf{a}\mathfrak{g}"))
    one = rows.select("doc_id", translate(F.col("text"), "unicode")["text"].alias("plain"), translate(F.concat(F.lit(r"\sin "), F.col("doc_id").cast("string")), "unicode")["text"].alias("word"))
    return one.withColumn("back", translate(F.col("plain"), "latex")["text"])


@BOOK.add("tex07_known_unsupported", f"SELECT {DOC}, {case([repr(x) for x in ('label', 'tag', 'nosuch', 'alpha')])} AS name FROM part WHERE p_partkey % 4 < 2")
def tex07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, chosen(["label", "tag", "nosuch", "alpha"])).withColumnRenamed("text", "name")
    return rows.join(F.broadcast(R.commands(spark).where("category = 'unsupported'").select("name")), "name", "left_semi").select("doc_id", "name")


@BOOK.add("tex10_unicode_tokens", f"SELECT {DOC}, unnest(['symbol', 'super', 'symbol', 'root', 'alphabet', 'space', 'number']) AS kind, unnest(['alpha', '12', 'leq', '√', 'R', ' ', {KEY}]) AS text, unnest([0, 2, 6, 9, 12, 15, 16]) AS s FROM part")
def tex10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.unicode_tokens_of(bodies(spark, sf_dir, F.concat(F.lit("α¹²≤√ℝ "), F.col("p_partkey").cast("string"))))
    return rows.select("doc_id", "kind", "text", "s")


_RANGES = document(("i", "p_partkey % 2 = 0", "Let \\(\\alpha \\leq x^{2}\\) be.\n\n"), ("d", "p_partkey % 3 = 0", "\\[\\frac{a}{b}\\]\n\n"), ("code", "p_partkey % 5 = 0", "`\\(\\beta\\)` stays.\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("tex11_ranges_in_place", f"SELECT {DOC}, {_RANGES.text_sql({'i': _lit('Let ' + chr(92) + '(α ≤ x²' + chr(92) + ') be.' + chr(10) * 2)})} AS text, CAST(p_partkey % 2 = 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER) AS n_regions, CAST(p_partkey % 3 = 0 AS INTEGER) AS n_losses FROM part")
def tex11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translated_regions(_RANGES.docs(spark, sf_dir), "unicode").select("doc_id", "text", "n_regions", F.size("losses").alias("n_losses"))


@BOOK.add("tex12_status", f"SELECT {DOC}, {case([repr(x) for x in ('unchanged', 'lossless', 'lossy')])} AS status FROM part")
def tex12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, chosen(["a + b", r"\alpha + b", r"\frac{a}{b}"]))
    return rows.select("doc_id", translate(F.col("text"), "unicode")["status"].alias("status"))


_DRAWN = {
    r"\frac{a+b}{c}": ("a+b|───| c ", 1, 3), r"\begin{pmatrix}a & bb\\ c & d\end{pmatrix}": ("⎛a  bb⎞|⎝c  d ⎠", 0, 7), r"x^{ab}_{i}": ("xᵢᵃᵇ", 0, 4),
    r"\left[\frac{1}{x}\right)": ("⎡1⎞|⎢─⎟|⎣x⎠", 1, 3), r"\sqrt[3]{xy}": ("³√(xy)", 0, 6), r"\begin{matrix}a": ("", 0, 0),
}


@BOOK.add("tex13_layout", f"SELECT {DOC}, {case([repr(v[0]) for v in _DRAWN.values()])} AS lines, {case([v[1] for v in _DRAWN.values()])} AS baseline, {case([v[2] for v in _DRAWN.values()])} AS width, p_partkey % {len(_DRAWN)} = {len(_DRAWN) - 1} AS failed FROM part")
def tex13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, chosen(list(_DRAWN))).select("doc_id", drawn(F.col("text")).alias("x"))
    return rows.select("doc_id", F.array_join("x.lines", "|").alias("lines"), "x.baseline", "x.width", F.col("x.error").isNotNull().alias("failed"))


_RENDERED = {r"\ce{H}": "missing-package:ce", r"\nosuch x": "unsupported-command:nosuch", r"\text{\alpha}": "math-in-text:alpha", r"\begin{theorem}a\end{theorem}": "unsupported-environment:theorem", r"\alpha \leq \text{if}": None, r"\my{x}": "unsupported-command:my"}


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\\[ "), chosen(list(_RENDERED)), F.lit(" \\]\n"))
    return Facts(bodies(spark, sf_dir, text), ["math_regions"]).table("math_regions")


def _issues_sql(known: dict[str, str | None]) -> str:
    codes = case([repr(v) if v else "NULL" for v in known.values()])
    return f"SELECT doc_id, code FROM (SELECT {DOC}, {codes} AS code FROM part) WHERE code IS NOT NULL"


@BOOK.add("rnd01_compatibility", _issues_sql(_RENDERED))
def rnd01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(_regions(spark, sf_dir)).select("doc_id", F.concat_ws(":", "code", "name").alias("code"))


_CLASSES = {"my": "macro", "text": "structural", "ce": "package", "alpha": "greek", "nosuch": "unsupported", "frac": "parsed"}


@BOOK.add("rnd02_command_class", f"SELECT {DOC}, {case([repr(c) for c in _CLASSES.values()])} AS class FROM part")
def rnd02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, chosen(list(_CLASSES))).withColumnRenamed("text", "name")
    return classified(rows, Profile().with_macro("my")).select("doc_id", "class")


_ENVS = ["align", "align*", "multline", "theorem"]


@BOOK.add("rnd03_environment_support", f"SELECT {DOC}, CASE p_partkey % 4 WHEN 2 THEN 'multline' ELSE 'theorem' END AS name, 'katex' AS renderer FROM part WHERE p_partkey % 4 >= 2 UNION ALL SELECT {DOC}, 'theorem', 'mathjax-v3' FROM part WHERE p_partkey % 4 = 3")
def rnd03(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = chosen(_ENVS)
    docs = bodies(spark, sf_dir, F.concat(F.lit("\\begin{"), name, F.lit("}a\\end{"), name, F.lit("}\n")))
    regions = Facts(docs, ["math_regions"]).table("math_regions").select("doc_id", F.lit(0).alias("n"), F.concat(F.lit("\\begin{"), "label", F.lit("}a\\end{"), "label", F.lit("}")).alias("text"))
    out = [issues(regions, Profile(r)).where("code = 'unsupported-environment'").select("doc_id", "name", F.lit(r).alias("renderer")) for r in ("mathjax-v3", "katex")]
    return out[0].unionByName(out[1])


@BOOK.add("rnd04_package_masks", f"SELECT {DOC}, {case([repr(x) for x in ('mhchem', 'cancel', 'braket')])} AS package, {case(['TRUE', 'FALSE', 'TRUE'])} AS loaded FROM part")
def rnd04(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = package_mask(Profile().with_package("mhchem").with_package("braket").packages)
    rows = bodies(spark, sf_dir, chosen(["mhchem", "cancel", "braket"])).withColumnRenamed("text", "package")
    return rows.select("doc_id", "package", (package_bit(F.col("package")).bitwiseAND(F.lit(mask)) != 0).alias("loaded"))


@BOOK.add("rnd05_math_in_text", f"SELECT {DOC}, CAST(CASE p_partkey % 2 WHEN 0 THEN 10 ELSE 22 END AS INTEGER) AS s FROM part")
def rnd05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for mathematics inside text mode, however deep, but not after it."""
    text = chosen([r"\[x \text{\beta} \gamma \]", r"\[\text{a {b} \mathrm{\delta}} \gamma\]"])
    return issues(Facts(bodies(spark, sf_dir, text), ["math_regions"]).table("math_regions")).where("code = 'math-in-text'").select("doc_id", "s")


@BOOK.add("rnd06_profiles", _issues_sql(_RENDERED | {r"\ce{H}": None, r"\my{x}": None}))
def rnd06(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = Profile().with_package("mhchem").with_macro("my", 1)
    return issues(_regions(spark, sf_dir), profile).select("doc_id", F.concat_ws(":", "code", "name").alias("code"))


# Commands of packages.
_OVERLAY = "ce mhchem, pu mhchem, cancel cancel, bcancel cancel, bra braket, ket braket, dv physics, SI siunitx, enclose enclose"


@BOOK.add("rnd07_overlay", " UNION ALL ".join(f"SELECT '{n}' AS name, '{p}' AS package" for n, p in (x.split(" ") for x in _OVERLAY.split(", "))))
def rnd07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(spark).where(F.col("name").isin([x.split(" ")[0] for x in _OVERLAY.split(", ")])).select("name", "package")


@BOOK.add("cli_math_command", f"SELECT {DOC}, 'a ≤ ' || {KEY} AS text, 'lossless' AS status FROM part")
def cli_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies(spark, sf_dir, F.concat(F.lit(r"a \leq "), F.col("p_partkey").cast("string"))).select("doc_id", translate(F.col("text"), "unicode").alias("x"))
    return rows.select("doc_id", "x.text", "x.status")
