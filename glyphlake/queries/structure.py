"""Facts of documents beyond the common slots, and mathematics: each on documents of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.functions import mathtext as M, text as T
from glyphlake.operators.facts import Facts, at_home, canonical, lines_of
from glyphlake.operators.fixtures import Expect, _lit
from glyphlake.operators.offsets import offset_map, to_original
from glyphlake.parse.facts import Options
from glyphlake.parse.math import ALIGNING, KNOWN
from glyphlake.queries.book import Book, document, table
from glyphlake.sources.scratch import spread

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
END = ("end", "TRUE", "Fin.\n")

_CRLF = "'a' || chr(13) || chr(10) || CAST(p_partkey AS VARCHAR(20)) || chr(13) || 'é' || chr(13) || chr(10) || 'x'"


@BOOK.add("prs02_original_ranges", f"SELECT {DOC}, CAST(strlen({_CRLF}) - 1 AS INTEGER) AS original, CAST(strlen({_CRLF}) - 3 AS INTEGER) AS canonical FROM part")
def prs02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{_CRLF.replace('VARCHAR(20)', 'STRING')} AS text")
    rows = rows.select("doc_id", offset_map("text").alias("map"), (F.octet_length(canonical("text")) - 1).alias("canonical"))
    return rows.select("doc_id", to_original(F.col("map"), F.col("canonical")).alias("original"), "canonical")


_PROSE = document(("a", "p_partkey % 2 = 0", "Café \\*x `code` tail\n\n"), END)
BOOK.fact("prs07_prose", "prose", _PROSE, [Expect("a", "0", "10", "1", extra="9 AS n_chars"), Expect("a", "16", "5", "16", extra="5 AS n_chars"), Expect("end", "0", "4", "1", extra="4 AS n_chars")], extra=lambda: {"n_chars": F.length("text")})

_LISTS = document(("ul", "p_partkey % 2 = 0", "-   one\n    more\n* two\n\n"), ("ol", "p_partkey % 3 = 0", "10. ten\n\n"), END)
BOOK.fact("prs11_item_widths", "item_widths", _LISTS, [Expect("ul", "0", "1", "1", extra="4 AS width"), Expect("ul", "17", "1", "1", 2, extra="2 AS width"), Expect("ol", "0", "3", "1", extra="4 AS width")], extra=lambda: {"width": F.col("n")})
_QUOTED = document(("q", "p_partkey % 2 = 0", "> one\n> - two\n>   three\n\n"), ("li", "p_partkey % 3 = 0", "1. a\n   b\n\n"), END)
BOOK.fact("prs12_container_prefixes", "transparent", _QUOTED, [Expect("q", "0", "2", "1"), Expect("q", "6", "4", "1", 1), Expect("q", "14", "4", "1", 2), Expect("li", "0", "3", "1"), Expect("li", "5", "3", "1", 1)])
BOOK.fact("prs15_checkpoints", "checkpoints", _QUOTED, [Expect("q", "0", "0", "1"), Expect("li", "0", "0", "1"), Expect("end", "0", "0", "1"), Expect("end", "5", "0", "1", 1)], where="not (kind = 'bookend' and s = 0)")
BOOK.fact(
    "prs16_tree", "tree", _QUOTED,
    [Expect("q", "0", "23", "1", extra="'quote' AS kind, -1 AS parent"), Expect("q", "2", "3", "3", extra="'paragraph', 0"), Expect("q", "8", "15", "3", 1, extra="'list', 0"), Expect("q", "8", "15", "3", 1, extra="'item', 2"), Expect("q", "10", "13", "5", 1, extra="'paragraph', 3")],
    extra=lambda: {"kind": F.col("kind"), "parent": F.coalesce(F.col("label").cast("int"), F.lit(-1))}, where="text < 5 and doc_id % 2 = 0",
)


@BOOK.add("prs20_label_casing", f"SELECT {DOC}, 'part' || CAST(p_partkey AS VARCHAR) AS label, 'PART' || CAST(p_partkey AS VARCHAR) AS spelled FROM part")
def prs20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first definition of each label spells it."""
    key = F.col("p_partkey").cast("string")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("text\n[PART"), key, F.lit("]: /1\n[Part"), key, F.lit("]: /2\n")).alias("text"))
    rows = lines_of(docs).select("doc_id", "line", F.regexp_extract("text", r"^ {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:", 1).alias("spelled")).where("spelled <> ''")
    return rows.groupBy("doc_id", T.normal_label(F.col("spelled")).alias("label")).agg(F.min_by("spelled", "line").alias("spelled"))


_REFS = document(("use", "TRUE", "See [one][A b], [two][] and [a  B].\n\n"), ("d1", "p_partkey % 2 = 0", "[a B]: /first\n[A  b]: /second\n\n"), ("d2", "p_partkey % 3 = 0", "[TWO]: </x>\n\n"), END)


def resolved(facts: Facts) -> DataFrame:
    """Reference links with the target of the first definition of their label: an equi-join on (document, label)."""
    links = facts.table("links").where("kind <> 'inline'").join(at_home(facts.docs.withColumnRenamed("text", "doc")), "doc_id")
    source = T.bytes_of(F.col("doc"), F.col("s"), F.col("e"))
    label = F.when(F.col("kind") == "full", F.regexp_extract(source, r"(?s)\]\[(.*)\]$", 1)).otherwise(F.col("text"))
    links = links.select("doc_id", "s", "e", "kind", T.normal_label(label).alias("label"))
    first = facts.table("link_defs").groupBy("doc_id", "label").agg(F.min_by(F.col("kind"), F.col("s")).alias("target"))
    return links.join(first, ["doc_id", "label"])


@BOOK.add(
    "prs21_reference_lookup",
    f"""WITH {_REFS.placed()} SELECT {DOC}, 'a b' AS label, 'full' AS kind, '/first' AS target, CAST(o_use + 4 AS INTEGER) AS s FROM o WHERE p_partkey % 2 = 0
    UNION ALL SELECT {DOC}, 'a b', 'shortcut', '/first', CAST(o_use + 28 AS INTEGER) FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, 'two', 'collapsed', '/x', CAST(o_use + 16 AS INTEGER) FROM o WHERE p_partkey % 3 = 0""",
)
def prs21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(Facts(_REFS.docs(spark, sf_dir), ["links", "link_defs"], share=True)).select("doc_id", "label", "kind", "target", "s")


@BOOK.add("prs22_unresolved_links", f"SELECT {DOC}, 'a b' AS label FROM part WHERE p_partkey % 2 <> 0 UNION ALL SELECT {DOC}, 'two' FROM part WHERE p_partkey % 3 <> 0")
def prs22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks like a full or collapsed reference and has no definition is text."""
    from glyphlake.rules.stdlib import in_text

    facts = Facts(_REFS.docs(spark, sf_dir), ["prose", "link_defs"], share=True)
    hits = in_text(facts, "prose", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]")
    label = F.coalesce(F.nullif(F.regexp_extract("m", r"\]\[(.*)\]$", 1), F.lit("")), F.regexp_extract("m", r"^\[(.*?)\]\[", 1))
    rows = hits.select("doc_id", T.normal_label(label).alias("label"))
    return rows.join(facts.table("link_defs").select("doc_id", "label"), ["doc_id", "label"], "left_anti")


_LINKS = document(("a", "p_partkey % 2 = 0", "Go http://a.org/x@b.org or me@c.org now.\n\n"), END)
BOOK.fact("prs25_autolinks_do_not_overlap", "autolinks", _LINKS, [Expect("a", "3", "20", "4", extra="'GfmUrl' AS kind"), Expect("a", "27", "8", "28", extra="'GfmEmail' AS kind")], extra=lambda: {"kind": F.col("kind")})

_HEADS = document(("h", "p_partkey % 2 = 0", "# Top {.c #id k=v .d}\n\n"), ("s", "p_partkey % 3 = 0", "Low {.x}\n---\n\n"), END)
BOOK.fact("prs27_heading_attributes", "heading_attrs", _HEADS, [Expect("h", "6", "15", "7", extra="'#id .c .d k=v' AS canonical"), Expect("s", "4", "4", "5", extra="'.x' AS canonical")], extra=lambda: {"canonical": T.canonical_attributes(F.col("text"))})
BOOK.fact("prs29_block_gaps", "block_gaps", _HEADS, [Expect("h", "21", "2", "22", extra="'heading' AS after"), Expect("s", "12", "2", "4", 1, extra="'heading' AS after")], extra=lambda: {"after": F.substring_index("kind", ">", 1)})
_PARAS = document(("p", "p_partkey % 2 = 0", "one `c` and [l](/u)\ntwo  \nthree\n\n"), ("q", "p_partkey % 3 = 0", "> quoted\n> text\n\n"), ("adm", "p_partkey % 5 = 0", "!!! note\n\n"), END)
BOOK.fact(
    "prs30_wrappable_paragraphs", "wrappable", _PARAS,
    [Expect("p", "0", "31", "1", extra="'document' AS owner, '' AS prefix, 2 AS atomics, '1' AS hard"), Expect("q", "2", "13", "3", extra="'quote', '> ', 0, '0'"), Expect("end", "0", "4", "1", extra="'document', '', 0, '0'")],
    extra=lambda: {"owner": F.col("kind"), "prefix": F.col("text"), "atomics": F.col("n"), "hard": F.col("label")},
)


@BOOK.add("prs31_admonitions", f"WITH {_PARAS.placed()} SELECT {DOC}, CAST(l_adm AS INTEGER) AS line FROM o WHERE p_partkey % 5 = 0")
def prs31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(_PARAS.docs(spark, sf_dir)).where(T.is_admonition(F.col("text"))).select("doc_id", "line")


BOOK.fact("prs32_link_targets", "link_dests", document(("a", "TRUE", "A [b](/c(d) \"t\") ![i](</p q>)\n\n"), END), [Expect("a", "6", "5", "7"), Expect("a", "22", "6", "23")])
_DEFS = document(("d", "p_partkey % 2 = 0", "[x]: /1\n[y]: <u v> 'T'\n[X]: /3\n\n"), ("code", "p_partkey % 3 = 0", "```\n[z]: /4\n```\n\n"), END)
BOOK.fact("prs33_definition_sites", "definition_sites", _DEFS, [Expect("d", "5", "2", "6"), Expect("d", "13", "5", "6", 1)])
_TIGHT = document(("t", "p_partkey % 2 = 0", "- a\n- b\n\n"), ("l", "p_partkey % 3 = 0", "+ a\n\n+ b\n\n"), ("n", "p_partkey % 5 = 0", "* a\n  - b\n\n    c\n\n"), END)
BOOK.fact(
    "prs34_list_tightness", "list_groups", _TIGHT,
    [Expect("t", "0", "7", "1", extra="'tight' AS tightness"), Expect("l", "0", "8", "1", extra="'loose' AS tightness"), Expect("n", "0", "16", "1", extra="'tight' AS tightness"), Expect("n", "6", "10", "3", 1, extra="'loose' AS tightness")],
    extra=lambda: {"tightness": F.col("text")},
)

_TOGGLED = document(("t", "p_partkey % 2 = 0", "| a |\n|---|\n\n"), ("u", "p_partkey % 3 = 0", "http://x.org and me@x.org\n\n"), ("h", "p_partkey % 5 = 0", "# H {#id}\n\n"), ("d", "p_partkey % 7 = 0", "Term\n: about\n\n"), END)
_TOGGLES = {
    "default": (Options(), (1, 2, 1, 0)), "no-tables": (Options(tables=False), (0, 2, 1, 0)), "urls": (Options(autolinks="urls"), (1, 1, 1, 0)), "no-links": (Options(autolinks="disabled"), (1, 0, 1, 0)),
    "no-attributes": (Options(heading_attributes=False), (1, 2, 0, 0)), "definitions": (Options(definition_lists=True), (1, 2, 1, 1)),
}


@BOOK.add(
    "prs37_extension_toggles",
    " UNION ALL ".join(
        f"SELECT '{name}' AS options, CAST(count(*) FILTER (WHERE p_partkey % 2 = 0) * {n[0]} AS BIGINT) AS tables, CAST(count(*) FILTER (WHERE p_partkey % 3 = 0) * {n[1]} AS BIGINT) AS autolinks, "
        f"CAST(count(*) FILTER (WHERE p_partkey % 5 = 0) * {n[2]} AS BIGINT) AS attributes, CAST(count(*) FILTER (WHERE p_partkey % 7 = 0) * {n[3]} AS BIGINT) AS definitions FROM part"
        for name, (_, n) in _TOGGLES.items()
    ),
)
def prs37(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (options, _) in _TOGGLES.items():
        rows = Facts(_TOGGLED.docs(spark, sf_dir), ["tables", "autolinks", "heading_attrs", "tree"], options)._all
        counts = rows.agg(*(F.count_if(F.expr(test)).alias(n) for n, test in (("tables", "fact = 'tables'"), ("autolinks", "fact = 'autolinks'"), ("attributes", "fact = 'heading_attrs'"), ("definitions", "fact = 'tree' and kind = 'definitions'"))))
        counts = counts.select(F.lit(name).alias("options"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


BOOK.fact("mth02_dollar_delimiters", "math_regions", document(("dollar", "p_partkey % 2 = 0", "Cost $x+1$ and $$y$$ now.\n\n"), END), [Expect("dollar", "5", "5", "6", extra="'inline' AS kind"), Expect("dollar", "15", "5", "16", extra="'display' AS kind")], Options(math="github"), lambda: {"kind": F.col("kind")})
BOOK.fact("mth03_exclusions", "math_regions", document(("code", "p_partkey % 3 = 0", "Code `\\(a\\)` then \\(b\\).\n\n"), ("fence", "p_partkey % 3 = 1", "```\n\\(c\\)\n```\n\n"), END), [Expect("code", "18", "5", "19")])
BOOK.fact("mth04_transparent_runs", "math_regions", document(("quote", "p_partkey % 11 = 0", "> \\[\n> {f\n> 1}\n> \\]\n\n"), END), [Expect("quote", "2", "17", "3", extra="true AS balanced")], extra=lambda: {"balanced": M.first_unbalanced(F.col("text")).isNull()})
BOOK.fact("mth05_escape_parity", "math_regions", document(("esc", "p_partkey % 5 = 0", "Not \\\\(d\\\\) but \\\\\\(e\\).\n\n"), END), [Expect("esc", "18", "5", "19")])
BOOK.fact("mth06_alphanumeric_guard", "math_regions", document(("guard", "p_partkey % 7 = 0", "Sign \\( + \\) or \\( + 1 \\).\n\n"), END), [Expect("guard", "16", "9", "17")])
BOOK.fact("mth07_nested_environments", "math_regions", document(("env", "p_partkey % 4 = 0", "\\begin{split}\\begin{split}a\\end{split} b\\end{split} c\n\n"), END), [Expect("env", "0", "51", "1", extra="'split' AS env")], extra=lambda: {"env": F.col("label")})

_ENVS = [*KNOWN, "theorem"]
_PICK = f"CASE p_partkey % {len(_ENVS)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_ENVS)) + " END"


@BOOK.add("mth08_environment_class", f"SELECT {DOC}, {_PICK} AS name, CASE WHEN {_PICK} IN ({', '.join(map(repr, ALIGNING))}) THEN 'aligning' WHEN {_PICK} = 'theorem' THEN 'custom' ELSE 'plain' END AS class FROM part")
def mth08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part")).selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{_PICK} AS name")
    text = F.concat(F.lit("\\begin{"), "name", F.lit("}\na\n\\end{"), "name", F.lit("}\n"))
    regions = Facts(rows.select("doc_id", text.alias("text")), ["math_regions"]).table("math_regions")
    return regions.select("doc_id", F.col("label").alias("name"), M.environment_class(F.col("label")).alias("class"))


_BODY = document(("quote", "p_partkey % 2 = 0", "> \\[\n> {f\n> é}}\n> \\]\n\n"), END)


@BOOK.add("mth09_clean_body", f"WITH {_BODY.placed()} SELECT {DOC}, {_lit(chr(10) + '{f' + chr(10) + 'é}}' + chr(10))} AS body, CAST(o_quote + 15 AS BIGINT) AS bad FROM o WHERE p_partkey % 2 = 0")
def mth09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without container prefixes; places in them are given in the source."""
    facts = Facts(_BODY.docs(spark, sf_dir), ["math_regions", "math_errors"], share=True)
    bad = facts.table("math_errors").where("kind = 'braces'").select("doc_id", F.col("s").cast("long").alias("bad"))
    return facts.table("math_regions").select("doc_id", F.col("text").alias("body")).join(bad, "doc_id")


_BRACES = ["{a}b", "{a", "a}b{", "\\{a{b}", "{{x}}}"]
_FIRST = [-1, 0, 1, -1, 5]


@BOOK.add("mth10_brace_balance", f"SELECT {DOC}, CASE p_partkey % 5 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_FIRST))} END AS bad FROM part")
def mth10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.element_at(F.array(*map(F.lit, _BRACES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.coalesce(M.first_unbalanced(bodies), F.lit(-1)).alias("bad"))


_KEY = "CAST(p_partkey AS VARCHAR)"


@BOOK.add("mth11_align_layout", f"SELECT {DOC}, chr(10) || rpad('a', CAST(length({_KEY}) AS INTEGER), ' ') || ' & =漢 ' || chr(92) || chr(92) || chr(10) || {_KEY} || ' & = c' || chr(10) AS body FROM part")
def mth11(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("\na&=漢\\\\\n"), key, F.lit("  &= c\n"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), M.aligned(body).alias("body"))


_FORMS = document(("i", "p_partkey % 2 = 0", "In \\( a \\) line.\n\n"), ("d", "p_partkey % 3 = 0", "\\[ b \\]\n\n"), ("e", "p_partkey % 5 = 0", "\\begin{align}c\\end{align}\n\n"), END)


@BOOK.add("mth12_dollar_form", " UNION ALL ".join(f"SELECT {DOC}, {_lit(new)} AS shown FROM part WHERE p_partkey % {m} = 0" for m, new in ((2, "$a$"), (3, "$$ b $$"), (5, "\\begin{align}c\\end{align}"))))
def mth12(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Facts(_FORMS.docs(spark, sf_dir), ["math_regions"])
    rows = facts.table("math_regions").join(at_home(facts.docs.withColumnRenamed("text", "doc")), "doc_id")
    return rows.select("doc_id", M.dollar_form(F.col("kind"), F.col("text"), T.bytes_of(F.col("doc"), F.col("s"), F.col("e"))).alias("shown"))
