"""Corpus-wide work: comparing, classifying, soaking, specifications, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.fmt.engine import formatted
from glyphlake.operators import compare as C
from glyphlake.operators.facts import Facts, at_home
from glyphlake.operators.fixtures import Recipe, _lit, markdown_docs
from glyphlake.operators.ranges import outside, require_disjoint
from glyphlake.queries.book import Book, document, table
from glyphlake.queries.relational import Derived
from glyphlake.queries.sources import _PATH, relative, tree
from glyphlake.sources import corpus
from glyphlake.sources.config import Fmt

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
END = ("end", "TRUE", "Fin.\n")

_OLD = document(("a", "TRUE", "one\ntwo\nthree\n"), ("gone", "p_partkey % 5 = 0", "old line\n"), END)
_NEW = document(("a", "p_partkey % 3 <> 0", "one\ntwo\nthree\n"), ("b", "p_partkey % 3 = 0", "one\n2\nthree\nmore\n"), END)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a corpus; of every eleventh document only one side is there."""
    old, new = _OLD.docs(spark, sf_dir).where("doc_id % 11 <> 0"), _NEW.docs(spark, sf_dir)
    return corpus.changed(old, new)


_SIDES = "WITH x AS (SELECT p_partkey AS k, p_partkey % 11 = 0 AS missing, 4 + CAST(p_partkey % 5 = 0 AS INTEGER) AS n_old, 4 + CAST(p_partkey % 3 = 0 AS INTEGER) AS n_new, 4 - CAST(p_partkey % 3 = 0 AS INTEGER) AS common FROM part), c AS (SELECT * FROM x WHERE missing OR n_old <> common OR n_new <> common)"


@BOOK.add("cor02_difference_summary", f"{_SIDES} SELECT count(*) AS changed_files, CAST(sum(CASE WHEN missing THEN 0 ELSE n_old - common END) AS BIGINT) AS deleted_lines, CAST(sum(CASE WHEN missing THEN n_new ELSE n_new - common END) AS BIGINT) AS inserted_lines FROM c")
def cor02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(pairs(spark, sf_dir))


@BOOK.add("cor03_common_lines", f"SELECT {DOC}, 4 - CAST(p_partkey % 3 = 0 AS INTEGER) AS common FROM part")
def cor03(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _OLD.docs(spark, sf_dir), _NEW.docs(spark, sf_dir).withColumnRenamed("text", "new")
    return old.join(new, "doc_id").select("doc_id", C.common_lines("text", "new").alias("common"))


_SPACED = document(("a", "TRUE", "A  _b_\nline\n\n"), ("l", "p_partkey % 3 = 0", "* x\n\n"), END)
_OTHERWISE = document(("a", "TRUE", "A *b*\nline\n\n"), ("l", "p_partkey % 3 = 0", "- x\n\n"), ("more", "p_partkey % 5 = 0", "More.\n\n"), END)


@BOOK.add("cor04_outcomes", f"SELECT {DOC}, CASE WHEN p_partkey % 7 = 0 THEN 'not-checked' WHEN p_partkey % 5 = 0 THEN 'drift' ELSE 'equivalent' END AS meaning, CASE WHEN p_partkey % 7 = 0 THEN 'not-checked' WHEN p_partkey % 5 = 0 THEN 'drift' ELSE 'equivalent' END AS html FROM part")
def cor04(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _SPACED.docs(spark, sf_dir).withColumnRenamed("text", "old"), _OTHERWISE.docs(spark, sf_dir).where("doc_id % 7 <> 0").withColumnRenamed("text", "new")
    return C.outcomes(a.join(b, "doc_id", "left"))


@BOOK.add("cor05_normal_html", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM pages")
def cor05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(C.normal_html(F.col("html"))).alias("digest"))


_TABLE = document(("head", "TRUE", "# Known\n\n| Corpus | Path | Status |\n| --- | --- | --- |\n"), ("a", "p_partkey % 2 = 0", "| `x` | a/** | fixed |\n"), ("b", "p_partkey % 3 = 0", "| y | b.md | open-bug |\n| short |\n"))


@BOOK.add("cor06_pipe_table_source", f"WITH {_TABLE.placed()} SELECT {DOC}, CAST(l_a AS INTEGER) AS ord, 'x' AS corpus, 'a/**' AS path, 'fixed' AS status FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, CAST(l_b AS INTEGER), 'y', 'b.md', 'open-bug' FROM o WHERE p_partkey % 3 = 0")
def cor06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.valid_status(C.table_rows(_TABLE.docs(spark, sf_dir), ["corpus", "path", "status"]))


_DIFFS = Derived("part", "TRUE", {"corpus": "'c' || CAST(p_partkey % 3 AS VARCHAR)", "path": "'d' || CAST(p_partkey % 4 AS VARCHAR) || '/e' || CAST(p_partkey % 5 AS VARCHAR) || '/f' || CAST(p_partkey AS VARCHAR) || '.md'"})
# The table of classes in its order, as fixed values: corpus, pattern, status.
_RULES = [("c0", "d1/e2/**", "fixed"), ("*", "d1/**", "configured"), ("c1", "d2/e0/f10.md", "open-bug"), ("c2", "*", "intentional-divergence"), ("*", "d2/e0/**", "open-bug")]
_MATCH = " ".join(
    f"WHEN {'TRUE' if c == '*' else f'corpus = {c!r}'} AND {'TRUE' if p == '*' else f'path LIKE {p[:-2]!r} || {chr(39)}%{chr(39)}' if p.endswith('/**') else f'path = {p!r}'} THEN {k}" for k, (c, p, _) in enumerate(_RULES)
)
_CLASSIFIED = f"WITH x AS (SELECT corpus, path, CASE {_MATCH} ELSE -1 END AS ord FROM {_DIFFS.sql})"
_STATUS = "CASE ord " + " ".join(f"WHEN {k} THEN '{s}'" for k, (_, _, s) in enumerate(_RULES)) + " END"


def classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(_RULES)], "ord int, corpus string, pattern string, status string")
    return C.classify(_DIFFS.frame(spark, sf_dir), rows)


@BOOK.add("cor07_first_match_classes", f"{_CLASSIFIED} SELECT corpus, path, ord, {_STATUS} AS status FROM x WHERE ord >= 0")
def cor07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir)[0]


@BOOK.add("cor07_unclassified", f"{_CLASSIFIED} SELECT corpus, path FROM x WHERE ord < 0")
def cor07_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir)[1]


@BOOK.add("cor08_not_idempotent", "SELECT CAST(0 AS BIGINT) AS doc_id WHERE FALSE UNION ALL SELECT CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey % 9 = 0")
def cor08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose second pass differs from the first; here the second pass of some is spoilt, which has to show."""
    first = formatted(markdown_docs(spark, sf_dir), Fmt(wrap=40)).select("doc_id", F.col("formatted").alias("text"))
    second = formatted(first, Fmt(wrap=40)).select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("formatted", F.lit("x"))).otherwise(F.col("formatted")).alias("text"))
    return corpus.changed(first, second).select("doc_id")


_GENERATED = ["d0/**", "d1/e1/f1.md"]


@BOOK.add("cor09_generated_documents", f"SELECT path FROM {_DIFFS.sql} WHERE path LIKE 'd0/%' OR path = 'd1/e1/f1.md'")
def cor09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _DIFFS.frame(spark, sf_dir).where(C.matches_any(F.col("path"), _GENERATED)).select("path")


@BOOK.add("cor10_soak", "SELECT count(*) AS files, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes, CAST(max(coalesce(strlen(text), 0)) AS BIGINT) AS largest, CAST(0 AS BIGINT) AS not_parsed, CAST(0 AS BIGINT) AS not_same, CAST(0 AS BIGINT) AS not_settled FROM documents")
def cor10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.soak_totals(C.soak(table(spark, sf_dir, "documents")))


@BOOK.add("cor11_slowest_documents", "SELECT CAST(10 AS BIGINT) AS n, TRUE AS timed")
def cor11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k that took longest. Which they are differs from run to run, so their number and that all were timed is returned."""
    return C.slowest(C.soak(table(spark, sf_dir, "documents")), 10).agg(F.count(F.lit(1)).alias("n"), F.every(F.col("seconds") > 0).alias("timed"))


_FALL = f"SELECT {_PATH} FROM nation WHERE n_regionkey % 5 = 2"


@BOOK.add("cor12_listed_or_walked", f"SELECT 'list' AS how, 'docs/A.md' AS path UNION ALL SELECT 'list', 'more.md' UNION ALL SELECT 'walk', path FROM ({_FALL}) UNION ALL SELECT 'walk', 'more.md'")
def cor12(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(spark, sf_dir, {"docs/A.md": "a\n", "more.md": "b\n"})
    out = []
    for how, names in (("list", ["docs/A.md"]), ("walk", ["docs/A.md", "docs/nosuch.md"])):
        rows = corpus.listed(spark, [f"{root}/{n}" for n in names], f"{root}/notes", [f"{root}/more.md"])
        out.append(relative(rows, root).select(F.lit(how).alias("how"), "path"))
    return out[0].unionByName(out[1])


_SPEC = Recipe([
    ("intro", "TRUE", _lit("# Spec {#top}\n\nText\n\n")), ("one", "TRUE", _lit(C.FENCE + " example\n→a\n# no head\n.\n<p>→a</p>\n" + C.FENCE + "\n\n")), ("sec", "p_partkey % 2 = 0", _lit("## Tables\n\n")),
    ("two", "p_partkey % 3 = 0", _lit(C.FENCE + " example table  x\n| a |\n.\n.\n" + C.FENCE + "\n")), ("end", "TRUE", _lit("Fin.\n")),
])


@BOOK.add(
    "cor13_specification_cases",
    f"SELECT {DOC}, CAST(1 AS BIGINT) AS number, 'Spec' AS section, '' AS classes, chr(9) || 'a' || chr(10) || '# no head' || chr(10) AS source, '<p>' || chr(9) || 'a</p>' || chr(10) AS html FROM part UNION ALL "
    f"SELECT {DOC}, 2, CASE WHEN p_partkey % 2 = 0 THEN 'Tables' ELSE 'Spec' END, 'table  x', '| a |' || chr(10), '.' || chr(10) FROM part WHERE p_partkey % 3 = 0",
)
def cor13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spec_cases(_SPEC.docs(spark, sf_dir))


_CASES = [
    ('<p>"</p>', "<p>&quot;</p>", '"', [], "S", "quote-escaping"), ("<table></table>", "<p>x</p>", "x", [], "S", "table-rendering"), ('<a href="http://x">', "<p>x</p>", "http://x", [], "S", "gfm-autolink"), ("<p>a</p>", "<p>b</p>", "a", ["tagfilter"], "S", "gfm-tagfilter"),
    ('<input type="checkbox">', "<p>x</p>", "x", [], "S", "tasklist-rendering"), ("<em>a</em>", "<p>a</p>", "*a*", [], "Emphasis and strong emphasis", "emphasis-resolution"), ("<b>", "<i>", "<b>", [], "S", "html-block-rendering"), ("a", "b", "c", [], "S", "other"),
]


@BOOK.add("cor14_mismatch_classes", f"SELECT {DOC}, CASE p_partkey % {len(_CASES)} " + " ".join(f"WHEN {k} THEN '{c[-1]}'" for k, c in enumerate(_CASES)) + " END AS class FROM part")
def cor14(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r"), F.lit(s).alias("s"), (F.array(*map(F.lit, c)) if c else F.expr("cast(array() as array<string>)")).alias("c"), F.lit(n).alias("n")) for a, b, s, c, n, _ in _CASES])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.element_at(cases, (F.col("p_partkey") % len(_CASES) + 1).cast("int")).alias("x"))
    return rows.select("doc_id", C.mismatch_class(F.col("x.l"), F.col("x.r"), F.col("x.s"), F.col("x.c"), F.col("x.n")).alias("class"))


_PLACED = document(("front", "p_partkey % 4 = 0", "---\nk: v\n---\n"), ("h", "TRUE", "# Café\n"), ("p", "p_partkey % 2 = 0", "Text é\nmore\n\n"), ("l", "p_partkey % 3 = 0", "- item\n\n"), END)


def _positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Position attributes for some elements; a quote that is not there is claimed for each document, and a list in front matter."""
    docs = _PLACED.docs(spark, sf_dir)
    first = F.when(F.col("doc_id") % 4 == 0, 4).otherwise(1)
    html = F.concat(
        F.lit('<h1 data-sourcepos="'), first, F.lit(":3-"), first, F.lit(':6">x</h1><BLOCKQUOTE class="q" data-sourcepos="'), first, F.lit(":1-"), first, F.lit(':2">'),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<p data-sourcepos="'), first + 1, F.lit(":6-"), first + 2, F.lit(':4">'))).otherwise(""), F.when(F.col("doc_id") % 4 == 0, '<ul data-sourcepos="1:1-2:4"><span data-sourcepos="1:1-1:1">').otherwise(""),
    )
    return docs, docs.select("doc_id", html.alias("html"))


_SPOTS = f"""WITH {_PLACED.placed()} SELECT {DOC}, 'heading' AS kind, CAST(o_h + 2 AS INTEGER) AS s, CAST(o_h + 7 AS INTEGER) AS e FROM o UNION ALL SELECT {DOC}, 'quote', CAST(o_h AS INTEGER), CAST(o_h + 2 AS INTEGER) FROM o
    UNION ALL SELECT {DOC}, 'paragraph', CAST(o_p + 5 AS INTEGER), CAST(o_p + 12 AS INTEGER) FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, 'list', 0, 8 FROM o WHERE p_partkey % 4 = 0"""


@BOOK.add("cor16_positions_without_fact", f"WITH {_PLACED.placed()} SELECT {DOC}, 'quote' AS kind, CAST(o_h AS INTEGER) AS s FROM o")
def cor16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed positions that no fact of their kind overlaps; what lies in front matter does not count."""
    docs, html = _positions(spark, sf_dir)
    facts = Facts(docs, ["nodes", "frontmatter"], share=True)
    claimed = outside(C.envelopes(html, facts.docs), at_home(facts.table("frontmatter")))
    return outside(claimed, at_home(facts.table("nodes")), same=("kind",)).select("doc_id", "kind", "s")


@BOOK.add("cor17_position_envelopes", _SPOTS)
def cor17(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, html = _positions(spark, sf_dir)
    return C.envelopes(html, docs)


@BOOK.add("cor18_accounting_by_status", f"{_CLASSIFIED} SELECT coalesce({_STATUS}, 'unclassified') AS status, count(*) AS n FROM x GROUP BY 1")
def cor18(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unknown = classified(spark, sf_dir)
    return known.select("status").unionByName(unknown.select(F.lit("unclassified").alias("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_CODED = document(
    ("f", "p_partkey % 2 = 0", "Let `α² ≤ β` hold, not `ABC` or `foo_bar`.\n\n"), ("m", "p_partkey % 3 = 0", "In \\( a `α` \\) and `x^{2}`.\n\n"), ("b", "p_partkey % 5 = 0", "```\nα ∈ ℝ\n```\n\n"), ("py", "p_partkey % 7 = 0", "```py\nα = 1\n```\n\n"), ("d", "p_partkey % 11 = 0", "`a ↗ α` and `when the value α is`\n\n"), END,
)
_FORMULAS = {"f": "Let \\(\\alpha^{2} \\leq \\beta\\) hold, not `ABC` or `foo_bar`.\n\n", "m": "In \\( a `α` \\) and \\(x^{2}\\).\n\n", "b": "\\[\n\\alpha \\in \\mathbb{R}\n\\]\n\n"}


@BOOK.add("cor19_code_to_mathematics", f"SELECT {DOC}, {_CODED.text_sql({k: _lit(v) for k, v in _FORMULAS.items()})} AS text FROM part")
def cor19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.migrate import migrated

    return migrated(_CODED.docs(spark, sf_dir))[0].select("doc_id", "text")


@BOOK.add("cor19_evidence", f"SELECT {DOC}, unnest(['label', 'code']) AS class FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, 'language' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT {DOC}, unnest(['diagram', 'prose']) FROM part WHERE p_partkey % 11 = 0")
def cor19_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.migrate import migrated

    return migrated(_CODED.docs(spark, sf_dir))[1].select("doc_id", "class")


_PLAIN = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": "CAST(p_partkey * 10 AS INTEGER)", "e": "CAST(p_partkey * 10 + p_size % 9 AS INTEGER)"})


@BOOK.add("cor20_disjoint_or_fail", f"SELECT doc_id, s, e, TRUE AS refused FROM {_PLAIN.sql}")
def cor20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that are disjoint pass in order; a set with an overlap is refused as a whole."""
    rows = _PLAIN.frame(spark, sf_dir)
    bad = rows.limit(1).select("doc_id", "s", (F.col("e") + 5).alias("e")).unionByName(rows.limit(1).select("doc_id", (F.col("s") + 1).alias("s"), (F.col("e") + 5).alias("e")))
    try:
        require_disjoint(bad).collect()
        refused = False
    except Exception as error:  # the driver gets it as a failed job
        refused = "edits overlap" in str(error)
    return require_disjoint(rows).withColumn("refused", F.lit(refused))


@BOOK.add("cor21_report_evidence", "SELECT n_name AS report, n_regionkey % 2 = 0 AS passed, CAST(n_nationkey AS BIGINT) AS files FROM nation")
def cor21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports of earlier runs, one line each, read back as rows."""
    import uuid

    from glyphlake.sources.scratch import shared_dir

    path = f"{shared_dir(spark)}/glyphlake/reports-{uuid.uuid4().hex}"
    reports = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_name").alias("report"), F.struct((F.col("n_regionkey") % 2 == 0).alias("passed"), F.col("n_nationkey").alias("files")).alias("result"))).alias("value"))
    reports.write.text(path)
    rows = spark.read.schema("report string, result struct<passed:boolean,files:long>").json(path)
    return rows.select("report", "result.passed", "result.files")


@BOOK.add("cor22_generated_rule_pages", "SELECT 'rules/' || name || '.md' AS path, '# ' || name AS head FROM (SELECT unnest(['bare-url', 'math/render-compat', 'stray-dollar']) AS name)")
def cor22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each rule, from the catalogue."""
    from glyphlake.rules.run import rule_pages

    pages = rule_pages(spark).where(F.col("path").isin("rules/bare-url.md", "rules/math/render-compat.md", "rules/stray-dollar.md"))
    return pages.select("path", F.substring_index("text", "\n", 1).alias("head"))
