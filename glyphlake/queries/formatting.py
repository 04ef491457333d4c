"""The formatter's families, plans, checks and options, each on documents of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.fmt import engine as E
from glyphlake.operators.facts import Facts
from glyphlake.operators.fixtures import Recipe, _lit, markdown_docs
from glyphlake.operators.ranges import drop_overlapping_families
from glyphlake.queries.book import Book, document, table
from glyphlake.queries.relational import Derived
from glyphlake.sources.config import Fmt
from glyphlake.sources.scratch import spread

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
END = ("end", "TRUE", "Fin.\n")
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
WORDS = "cast(p_partkey as string)"


def formats(name: str, recipe: Recipe, options: Fmt, new: dict[str, str]) -> None:
    """Documents, and what some of their slots become."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.formatted(recipe.docs(spark, sf_dir), options).select("doc_id", F.col("formatted").alias("text"))

    QUERIES[name], ORACLE[name] = run, f"SELECT {DOC}, {recipe.text_sql({k: _lit(v) for k, v in new.items()})} AS text FROM part"


formats("fmt03_list_marker", document(("ul", "p_partkey % 2 = 0", "- one\n- two\n\n"), ("mixed", "p_partkey % 3 = 0", "Para.\n\n* a\n  - b\n* c\n\n"), ("p", "TRUE", "Between.\n\n"), ("plus", "p_partkey % 5 = 0", "+ done\n\n"), END), Fmt(list_marker="plus"), {"ul": "+ one\n+ two\n\n", "mixed": "Para.\n\n+ a\n  + b\n+ c\n\n"})
# Two neighbouring lists stay two. Candidates that fail together are tried for themselves: the third item alone may change.
formats("fmt03_neighbouring_lists", document(("two", "TRUE", "- one\n- two\n* three\n\n"), END), Fmt(list_marker="plus"), {"two": "- one\n- two\n+ three\n\n"})
formats("fmt07_heading_attributes", document(("h", "p_partkey % 2 = 0", "# Top {.c #id k=v .d}\n\n"), ("ok", "p_partkey % 3 = 0", "## Low {#x .y}\n\n"), END), Fmt(heading_attrs="canonicalise"), {"h": "# Top {#id .c .d k=v}\n\n"})
formats("fmt12_heading_gaps", document(("a", "p_partkey % 2 = 0", "Text\n# Head\nMore\n\n\n\n"), ("b", "p_partkey % 3 = 0", "## Second\n\n\nTail\n\n"), END), Fmt(blank_line_before_heading="one", blank_line_after_heading="one"), {"b": "## Second\n\nTail\n\n", "a": "Text\n\n# Head\n\nMore\n\n"})
ORACLE["fmt12_heading_gaps"] = (
    f"SELECT {DOC}, CASE WHEN p_partkey % 2 = 0 THEN {_lit('Text' + chr(10) * 2 + '# Head' + chr(10) * 2 + 'More')} || CASE WHEN p_partkey % 3 = 0 THEN {_lit(chr(10) * 2)} ELSE {_lit(chr(10) * 4)} END ELSE '' END"
    f" || CASE WHEN p_partkey % 3 = 0 THEN {_lit('## Second' + chr(10) * 2 + 'Tail' + chr(10) * 2)} ELSE '' END || {_lit('Fin.' + chr(10))} AS text FROM part"
)


@BOOK.add("fmt14_tokens", f"SELECT {DOC}, 'see|`a b`,|[the link](/u)|' || CAST(p_partkey AS VARCHAR) AS tokens FROM part")
def fmt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pieces(text: str) -> str:
        (_, line), *_ = E.read(text).inlines
        return "|".join(E.tokens(line.text, [(p.start, p.end) for p in line.pieces if p.kind in E.SOLID]))

    text = F.concat(F.lit("see `a b`, [the link](/u) "), F.expr(WORDS))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), E.text_function(pieces, "string")(text).alias("tokens"))


_FILL = "p_name || ' of ' || p_type || ' and ' || p_brand"


@BOOK.add(
    "fmt15_greedy_fill",
    f"""WITH RECURSIVE w AS (SELECT {DOC}, string_split({_FILL}, ' ') AS ws FROM part),
    g AS (SELECT doc_id, ws, 1 AS k, ws[1] AS line, CAST([] AS VARCHAR[]) AS lines FROM w UNION ALL
      SELECT doc_id, ws, k + 1, CASE WHEN length(line) + 1 + length(ws[k+1]) <= 14 THEN line || ' ' || ws[k+1] ELSE ws[k+1] END,
        CASE WHEN length(line) + 1 + length(ws[k+1]) <= 14 THEN lines ELSE list_append(lines, line) END FROM g WHERE k < len(ws))
    SELECT doc_id, array_to_string(list_append(lines, line), '|') AS lines FROM g WHERE k = len(ws)""",
)
def fmt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), E.filled(F.expr(_FILL), F.lit(14), F.lit("stable")).alias("lines"))
    return rows.select("doc_id", F.array_join("lines", "|").alias("lines"))


@BOOK.add(
    "fmt16_balanced_fill",
    f"""WITH RECURSIVE w AS (SELECT {DOC}, string_split({_FILL}, ' ') AS ws FROM part),
    c AS (SELECT doc_id, ws, 0 AS j, CAST(0 AS BIGINT) AS cost FROM w UNION ALL
      SELECT doc_id, ws, k, cost + CASE WHEN k = len(ws) THEN 0 ELSE slack * slack END FROM (
        SELECT doc_id, ws, cost, k, 16 - length(array_to_string(ws[j+1:k], ' ')) AS slack FROM (SELECT doc_id, ws, cost, j, unnest(range(j + 1, len(ws) + 1)) AS k FROM c WHERE j < len(ws))) WHERE slack >= 0)
    SELECT doc_id, CAST(min(cost) AS BIGINT) AS cost, TRUE AS fits, TRUE AS whole FROM c WHERE j = len(ws) GROUP BY doc_id""",
)
def fmt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties may be broken either way, so what is compared is the cost, and that the lines fit and keep the words."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.expr(_FILL).alias("t"), E.filled(F.expr(_FILL), F.lit(16), F.lit("balanced")).alias("lines"))
    slack = F.transform(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x: (16 - F.length(x)) * (16 - F.length(x)))
    return rows.select("doc_id", F.aggregate(slack, F.lit(0).cast("long"), lambda a, x: a + x).alias("cost"), F.forall("lines", lambda x: F.length(x) <= 16).alias("fits"), (F.array_join("lines", " ") == F.col("t")).alias("whole"))


_ITEM = document(("li", "p_partkey % 2 = 0", "- one two three four\n\n"), ("ol", "p_partkey % 3 = 0", "1. one two three four\n\n"), END)
formats("fmt17_continuation_marker_width", _ITEM, Fmt(wrap=12), {"li": "- one two\n  three four\n\n", "ol": "1. one two\n   three\n   four\n\n"})
formats("fmt17_continuation_four_space", _ITEM, Fmt(wrap=12, continuation_indent="four-space"), {"li": "- one two\n    three\n    four\n\n", "ol": "1. one two\n    three\n    four\n\n"})


@BOOK.add("fmt19_line_ends", f"SELECT {DOC}, 'a' || chr(13) || chr(10) || {WORDS} || chr(13) || chr(10) AS crlf, 'a' || chr(10) || {WORDS} || chr(10) AS lf, CASE WHEN p_partkey % 2 = 0 THEN 'a' || chr(13) || chr(10) || {WORDS} || chr(13) || chr(10) ELSE 'a' || chr(10) || {WORDS} || chr(10) END AS kept FROM part".replace(WORDS, "CAST(p_partkey AS VARCHAR)"))
def fmt19(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("a"), end, F.expr(WORDS), end).alias("text"))
    out = docs.select("doc_id")
    for name, how in (("crlf", "crlf"), ("lf", "lf"), ("kept", "keep")):
        out = out.join(E.formatted(docs, Fmt(end_of_line=how)).select("doc_id", F.col("formatted").alias(name)), "doc_id")
    return out


_EDITED = document(("em", "p_partkey % 2 = 0", "Some _soft_ and `_code_` words.\n\n"), ("ul", "p_partkey % 3 = 0", "* one\n\n"), END)


@BOOK.add("fmt20_owned_edits", f"WITH {_EDITED.placed()} SELECT {DOC}, 'italic' AS family, CAST(o_em + unnest([5, 10]) AS INTEGER) AS s FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, 'list-marker', CAST(o_ul AS INTEGER) FROM o WHERE p_partkey % 3 = 0")
def fmt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits need a block of the right kind around them; one that was put elsewhere is dropped."""
    docs = _EDITED.docs(spark, sf_dir)
    edits = E.candidates(docs, Fmt(italic="asterisk", list_marker="dash"), ["italic", "list-marker"])
    astray = docs.select("doc_id", F.lit("tables").alias("family"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit("|").alias("replacement"))
    return E.owned(edits.unionByName(astray), Facts(docs, ["nodes"]).table("nodes")).select("doc_id", "family", "s")


_PLAN = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey % 40 AS BIGINT)", "family": "CASE WHEN p_partkey % 2 = 0 THEN 'italic' ELSE 'tables' END", "s": "CAST((p_partkey * 37) % 9973 AS INTEGER)", "e": "CAST((p_partkey * 37) % 9973 + 1 + p_size AS INTEGER)", "replacement": "CAST(p_partkey AS VARCHAR)"})


@BOOK.add("fmt21_plan", f"WITH p AS {_PLAN.sql}, b AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id, family ORDER BY s, e) < e, FALSE) AS clash FROM p) SELECT doc_id, family, s, e, replacement FROM b WHERE (doc_id, family) NOT IN (SELECT (doc_id, family) FROM b WHERE clash)")
def fmt21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_overlapping_families(_PLAN.frame(spark, sf_dir))


_SALVAGE = document(("two", "TRUE", "- one\n- two\n* three\n\n"), ("p", "TRUE", "Between.\n\n"), ("more", "p_partkey % 2 = 0", "- four\n\n"), END)


@BOOK.add("fmt22_salvage", f"SELECT {DOC}, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END AS proposed, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS applied, 2 AS rejected FROM part")
def fmt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fails its check is taken apart; what passes alone stays."""
    docs = _SALVAGE.docs(spark, sf_dir)
    one = E.text_function(lambda t: "/".join(map(str, E.salvaged(t, Fmt(list_marker="plus"), "list-marker"))), "string")
    x = F.split("x", "/")
    return docs.select("doc_id", one(F.col("text")).alias("x")).select("doc_id", *(x[k].cast("int").alias(n) for k, n in enumerate(("proposed", "applied", "rejected"))))


@BOOK.add("fmt23_fixed_point", f"SELECT {DOC}, TRUE AS converged, TRUE AS settled FROM part")
def fmt23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families together come to rest, and a second run changes nothing."""
    o = Fmt(italic="asterisk", strong="asterisk", list_marker="dash", ordered_list="consistent", thematic_break="dash", refs_style="angle", tables_style="align", blank_line_before_heading="one", wrap=40)
    once = E.formatted(markdown_docs(spark, sf_dir), o).select("doc_id", F.col("formatted").alias("text"), "converged")
    again = E.formatted(once, o).select("doc_id", (~F.col("changed")).alias("settled"))
    return once.select("doc_id", "converged").join(again, "doc_id")


_SAID = "'# A *b*' || chr(10) || chr(10) || 'x  y' || chr(10) || 'z ' || " + WORDS + " || chr(10)"
_SAME = "'A _b_' || chr(10) || '===' || chr(10) || 'x y z ' || " + WORDS
_OTHER = "'# A *b*' || chr(10) || chr(10) || 'x y zz ' || " + WORDS + " || chr(10)"


def _said(spark: SparkSession, sf_dir: str, other: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{_SAID} AS a", f"{other} AS b")


@BOOK.add("fmt24_signatures", f"SELECT {DOC}, 4 AS elements, TRUE AS same FROM part")
def fmt24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, _SAME).select("doc_id", E.meaning(F.col("a")).alias("a"), E.meaning(F.col("b")).alias("b"))
    return rows.select("doc_id", F.size("a").alias("elements"), (F.col("a") == F.col("b")).alias("same"))


@BOOK.add("fmt25_first_divergence", f"SELECT {DOC}, FALSE AS same, 3 AS at FROM part")
def fmt25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.functions.text import first_difference

    rows = _said(spark, sf_dir, _OTHER).select("doc_id", E.meaning(F.col("a")).alias("a"), E.meaning(F.col("b")).alias("b"))
    return rows.select("doc_id", (F.col("a") == F.col("b")).alias("same"), first_difference(F.col("a"), F.col("b"))["at"].alias("at"))


_MATHS = document(("i", "p_partkey % 2 = 0", "In \\( a \\) line.\n\n"), ("d", "p_partkey % 3 = 0", "\\[ b \\]\n\n"), END)
formats("fmt26_verified_mathematics", _MATHS, Fmt(math_render="dollar"), {"i": "In $a$ line.\n\n", "d": "$$ b $$\n\n"})
# A dollar that stands there would pair with a new one: such a rewrite is rejected.
formats("fmt26_rejected_mathematics", document(("i", "TRUE", "Pay $5,\\( a \\) now.\n\n"), END), Fmt(math_render="dollar"), {})
formats("fmt27_front_matter_removal", document(("front", "p_partkey % 2 = 0", "---\ntitle: x\n---\n\n\n"), ("h", "TRUE", "# Head\n\n"), ("rule", "p_partkey % 3 = 0", "---\n\n"), END), Fmt(frontmatter_preserve=False), {"front": ""})


@BOOK.add("fmt28_format_with_report", f"SELECT {DOC}, p_partkey % 18 = 0 AS changed, CASE WHEN p_partkey % 18 = 0 THEN 2 ELSE 0 END AS applied FROM part")
def fmt28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.formatted(markdown_docs(spark, sf_dir)).select("doc_id", "changed", "applied")


_RANGE = document(("a", "TRUE", "* one\n\n"), ("b", "p_partkey % 2 = 0", "Some _soft_ words.\n\n"), ("c", "TRUE", "An _other_ line.\n\n"))


@BOOK.add("fmt30_range_format", f"WITH {_RANGE.placed()} SELECT {DOC}, CAST(o_b AS INTEGER) AS s, CAST(o_b + 18 AS INTEGER) AS e, 'Some *soft* words.' AS text FROM o WHERE p_partkey % 2 = 0")
def fmt30(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = E.text_function(lambda t, at: "/".join(map(str, E.format_range(t, at, at + 2, Fmt(italic="asterisk")))), "string")
    rows = _RANGE.docs(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.split(one(F.col("text"), F.lit(12)), "/", 3).alias("x"))
    return rows.select("doc_id", F.col("x")[0].cast("int").alias("s"), F.col("x")[1].cast("int").alias("e"), F.col("x")[2].alias("text"))


_STYLED = document(("em", "p_partkey % 2 = 0", "Some _soft_ and __hard__.\n\n"), ("ul", "p_partkey % 3 = 0", "* one\n* two\n\n"), ("p", "TRUE", "Mid.\n\n"), ("ol", "p_partkey % 5 = 0", "3. c\n7. d\n\n"), ("hr", "p_partkey % 7 = 0", "***\n\n"), END)
_MDFORMAT = {"em": "Some *soft* and **hard**.\n\n", "ul": "- one\n- two\n\n", "ol": "3. c\n3. d\n\n", "hr": "_" * 70 + "\n\n"}
formats("fmt32_profile_preserve", _STYLED, Fmt(), {})
formats("fmt32_profile_mdformat", _STYLED, Fmt(profile="mdformat"), _MDFORMAT)
formats("fmt32_profile_with_own_choice", _STYLED, Fmt(profile="mdformat", list_marker="plus"), _MDFORMAT | {"ul": "+ one\n+ two\n\n"})


@BOOK.add("fmt33_explanations", f"SELECT {DOC}, '2 proposed, 2 applied, 0 rejected' AS note FROM part WHERE p_partkey % 18 = 0")
def fmt33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.explanation(E.formatted(markdown_docs(spark, sf_dir)))
