"""Where documents come from and where results go: files, configuration, HTML, records and texts for people."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts
from glyphlake.operators.fixtures import Expect, _lit, expected_rows, markdown_docs, placed_sql
from glyphlake.queries.book import Book, document, table
from glyphlake.rules.run import catalogue, diagnostics, json_lines, pretty, select
from glyphlake.sources import config, corpus
from glyphlake.sources.files import Files
from glyphlake.sources.scratch import shared_dir

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
END = ("end", "TRUE", "Fin.\n")
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
#: Where the file of a nation lies, by its region; region 3 gives no Markdown, region 4 lies where nobody looks.
_FOLDERS = ["docs/{}.md", "docs/sub/{}.markdown", "notes/{}.md", "notes/{}.txt", "docs/node_modules/{}.md"]


def tree(spark: SparkSession, sf_dir: str, more: dict[str, str] | None = None) -> str:
    """A folder with one small file for each of the 25 nations; returns its path."""
    root, files = f"{shared_dir(spark)}/glyphlake/tree-{uuid.uuid4().hex}", Files(spark)
    for r in table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect():
        files.write(f"{root}/{_FOLDERS[r.n_regionkey % 5].format(r.n_name.replace(' ', '_'))}", f"# {r.n_name}.\n")
    for path, text in (more or {}).items():
        files.write(f"{root}/{path}", text)
    return files.absolute(root)


def relative(rows: DataFrame, root: str) -> DataFrame:
    return rows.select(F.substring("path", len(root.removeprefix("file:")) + 2, 1 << 30).alias("path"), F.octet_length("text").alias("n_bytes"))


_NAME = "replace(n_name, ' ', '_')"
_PATH = f"CASE n_regionkey % 5 WHEN 0 THEN 'docs/' || {_NAME} || '.md' WHEN 1 THEN 'docs/sub/' || {_NAME} || '.markdown' ELSE 'notes/' || {_NAME} || '.md' END AS path"
_SIZE = "CAST(strlen(n_name) + 4 AS INTEGER) AS n_bytes"


@BOOK.add("src01_scan", f"SELECT {_PATH}, {_SIZE} FROM nation WHERE n_regionkey % 5 < 3 AND n_name NOT LIKE 'A%'")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(spark, sf_dir, {".gitignore": "# all that begin so\nA*\n"})
    return relative(corpus.scan(spark, [root]), root)


_DIRS = [*corpus.SKIPPED, "targets", "src"]
_DIR = f"CASE p_partkey % {len(_DIRS)} " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(_DIRS)) + " END"


@BOOK.add("src02_skipped_folders", f"SELECT {DOC}, {_DIR} AS folder FROM part WHERE {_DIR} IN ('targets', 'src')")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{_DIR} AS folder")
    return rows.where(~corpus.in_skipped_folder(F.concat(F.lit("a/"), "folder", F.lit("/x.md"))))


@BOOK.add("src03_roots_once", f"SELECT row_number() OVER (ORDER BY path) AS k, path FROM (SELECT {_PATH} FROM nation WHERE n_regionkey % 5 < 2)")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that overlap, each file once, in the order of paths; a root that is missing is an error."""
    root = tree(spark, sf_dir)
    try:
        corpus.scan(spark, [f"{root}/nosuch"])
    except corpus.MissingRoot:
        rows = relative(corpus.scan(spark, [f"{root}/docs", f"{root}/docs/sub"]), root).orderBy("path")
    from pyspark.sql import Window as W

    return rows.select(F.row_number().over(W.orderBy("path")).cast("long").alias("k"), "path")  # 25 files


_FILE = "'d' || CAST(p_partkey % 3 AS VARCHAR(20)) || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'gen/' ELSE '' END || 'p' || CAST(p_partkey AS VARCHAR(20)) || '.md'"


@BOOK.add("src04_exclude_globs", f"SELECT {_FILE} AS path, p_partkey % 3 = 1 OR (p_partkey % 2 = 0 AND NOT {_FILE} LIKE '%/p1_.md') AS lint_out, {_FILE} LIKE 'd0/p%' AS fmt_out FROM part")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(f"{_FILE.replace('VARCHAR(20)', 'STRING')} AS path")
    lint, fmt = ["# comment", "gen/", "!p1?.md", "/d1/"], ["/d0/*.md"]
    return rows.select("path", corpus.excluded(F.col("path"), lint).alias("lint_out"), corpus.excluded(F.col("path"), fmt).alias("fmt_out"))


@BOOK.add("src05_stdin", "SELECT '<stdin>' AS path, 'piped in' AS text UNION ALL SELECT '<stdin>', 'refused'")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = corpus.from_text(spark, "piped in", limit=8)
    try:
        bad = corpus.from_text(spark, "piped in too", limit=8)
    except ValueError:
        bad = good.withColumn("text", F.lit("refused"))
    return good.unionByName(bad).select("path", "text")


@BOOK.add("src06_concatenated", "SELECT CAST(0 AS BIGINT) AS doc_id, string_agg('# ' || n_name, chr(10) ORDER BY n_name) AS text FROM nation")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.joined(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.concat(F.lit("# "), "n_name", F.lit("\n")).alias("text")))


@BOOK.add("src07_size_cap", "SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN strlen(text) > 2000 THEN 'too large' ELSE 'admitted' END AS outcome FROM documents")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = corpus.admitted(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=2000)
    return good.select("doc_id", F.lit("admitted").alias("outcome")).unionByName(bad.select("doc_id", F.col("error").alias("outcome")))


@BOOK.add("src08_control_characters", f"SELECT {DOC}, CASE WHEN p_partkey % 4 = 0 THEN 'control character' ELSE 'admitted' END AS outcome FROM part")
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.element_at(F.array(*map(F.lit, "\x07\t\n\x0c")), (F.col("p_partkey") % 4 + 1).cast("int"))
    good, bad = corpus.admitted(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat("p_name", odd).alias("text")), limit=0)
    return good.select("doc_id", F.lit("admitted").alias("outcome")).unionByName(bad.select("doc_id", F.col("error").alias("outcome")))


@BOOK.add("src09_config_discovery", "SELECT unnest(['docs', 'docs/sub', 'notes', 'apart/deep', 'apart/none']) AS start, unnest(['all', 'none', 'all', 'none', 'default']) AS preset")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = config.TOOL
    root, files = tree(spark, sf_dir, {
        f"{t}.toml": "[lint]\npreset = 'all'\n", f"docs/sub/.{t}.toml": "[lint]\npreset = 'none'\n", "apart/.git/HEAD": "x", "apart/none/x.md": "", "apart/deep/x.md": "",
        "apart/deep/pyproject.toml": f"[tool.{t}.lint]\npreset = 'none'\n", "notes/pyproject.toml": "[tool.other]\nx = 1\n",
    }), Files(spark)
    starts = ["docs", "docs/sub", "notes", "apart/deep", "apart/none"]
    return spark.createDataFrame([(s, config.resolve(files, f"{root}/{s}").lint.preset) for s in starts], "start string, preset string")


_CONFIGS = [("[lint]\nignore = ['bare-url']\n", "ok"), ("[lint]\nnosuch = 1\n", "unknown key lint.nosuch"), ("[fmt]\nitalic = 'bold'\n", "fmt.italic must be one of asterisk, preserve, underscore"), ("[other]\n", "unknown key other"), ("[fmt]\nwrap = 80\n", "ok")]


@BOOK.add("src10_strict_config", " UNION ALL ".join(f"SELECT {k} AS k, '{v}' AS outcome" for k, (_, v) in enumerate(_CONFIGS)))
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, root, files = [], tree(spark, sf_dir, {f"c{k}.toml": text for k, (text, _) in enumerate(_CONFIGS)}), Files(spark)
    for k in range(len(_CONFIGS)):
        try:
            config.resolve(files, explicit=f"{root}/c{k}.toml")
            out.append((k, "ok"))
        except config.ConfigError as error:
            out.append((k, str(error)))
    return spark.createDataFrame(out, "k int, outcome string")


@BOOK.add("snk01_rewrite_changed", f"SELECT {_PATH}, CAST(strlen(n_name) + 3 AS INTEGER) AS n_bytes, CAST(1 AS BIGINT) AS changed FROM nation WHERE n_regionkey % 5 < 3")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fix the files of a tree in place; a second pass finds none to change."""
    from glyphlake.rules.run import fixed

    root = tree(spark, sf_dir)

    def changes() -> DataFrame:
        old = corpus.numbered(corpus.scan(spark, [root]))
        new = fixed(old, diagnostics(old, select("none,+heading-punctuation"), locate=False)).join(old.select("doc_id", "path"), "doc_id")
        return corpus.rewritten(old, new.select("path", "text"))

    first, second = corpus.write_back(changes()), corpus.write_back(changes())
    return relative(corpus.scan(spark, [root]), root).withColumn("changed", F.lit(int(first > 0 and second == 0)).cast("long"))


_H1 = "heading-punctuation"
_FOUND = f"WITH {placed_sql()}, x AS ({expected_rows(_H1, [Expect('h1', '7 + length(CAST(p_partkey AS VARCHAR))', '1', '8 + length(CAST(p_partkey AS VARCHAR))', when='p_partkey % 4 = 0')])})"


def _heading_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = markdown_docs(spark, sf_dir)
    return docs, diagnostics(docs, select(f"none,+{_H1}"), suppress=False).withColumn("path", F.concat(F.lit("p"), "doc_id", F.lit(".md")))


@BOOK.add("snk04_json_lines_v1", f"""{_FOUND} SELECT '{{"path":"p' || doc_id || '.md","rule":"{_H1}","line":' || line || ',"column":' || col || ',"message":"heading ends in .","advisory":false}}' AS value FROM x""")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _heading_findings(spark, sf_dir)
    return json_lines(found, docs, version=1)


@BOOK.add(
    "snk06_pretty",
    f"""{_FOUND} SELECT 'warning[{_H1}]: heading ends in .' || chr(10) || ' --> p' || doc_id || '.md:' || line || ':' || col || chr(10) || '  | # Part ' || doc_id || '.' || chr(10) || '  | ' || repeat(' ', CAST(col - 1 AS BIGINT)) || '^' || chr(10) || '  = fix: {{"replacement":""}}' AS value FROM x""",
)
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _heading_findings(spark, sf_dir)
    return pretty(found, docs)


_HTML = document(
    ("h", "p_partkey % 2 = 0", "# A *b* {#id .c}\n\n"), ("p", "TRUE", 'One "two" <b>x</b> & [l](/u v "t") `c<d`\\\nend\n\n'.replace("/u v", "</u v>")), ("li", "p_partkey % 3 = 0", "- [x] a\n- b\n\n"),
    ("t", "p_partkey % 5 = 0", "| a | b |\n|--:|---|\n| 1 | 2 |\n\n"), ("code", "p_partkey % 7 = 0", "```py\na<b\n```\n\n"), ("raw", "p_partkey % 11 = 0", "<script>x</script>\n\n"), ("q", "p_partkey % 13 = 0", "> quoted\n\n"),
)
_HTML_DEFAULT = {
    "h": '<h1 id="id" class="c">A <em>b</em></h1>\n', "p": '<p>One "two" <b>x</b> &amp; <a href="/u v" title="t">l</a> <code>c&lt;d</code><br />\nend</p>\n',
    "li": '<ul>\n<li><input disabled="" type="checkbox" checked="" />\na</li>\n<li>b</li>\n</ul>\n',
    "t": '<table><thead><tr><th style="text-align: right">a</th><th>b</th></tr></thead><tbody>\n<tr><td style="text-align: right">1</td><td>2</td></tr>\n</tbody></table>\n',
    "code": '<pre><code class="language-py">a&lt;b\n</code></pre>\n', "raw": "<script>x</script>\n", "q": "<blockquote>\n<p>quoted</p>\n</blockquote>\n",
}
_HTML_GFM = _HTML_DEFAULT | {
    "p": '<p>One &quot;two&quot; <b>x</b> &amp; <a href="/u%20v" title="t">l</a> <code>c&lt;d</code><br />\nend</p>\n', "li": '<ul>\n<li><input type="checkbox" checked="" disabled="" /> a</li>\n<li>b</li>\n</ul>\n',
    "t": '<table>\n<thead>\n<tr>\n<th align="right">a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td align="right">1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>\n', "raw": "&lt;script>x&lt;/script>\n",
}


def _html_sql(parts: dict[str, str]) -> str:
    return f"SELECT {DOC}, {_HTML.text_sql({n: _lit(t) for n, t in parts.items()})} AS html FROM part"


@BOOK.add("snk07_html_default", _html_sql(_HTML_DEFAULT))
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.render.html import rendered

    return rendered(_HTML.docs(spark, sf_dir))


@BOOK.add("snk08_html_gfm", _html_sql(_HTML_GFM))
def snk08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.render.html import rendered

    return rendered(_HTML.docs(spark, sf_dir), "gfm")


@BOOK.add("snk09_html_highlighted", f"SELECT {DOC}, chr(27) || '[34m<a href=' || chr(27) || '[36m\"/x\"' || chr(27) || '[34m>' || chr(27) || '[0m' || p_name || chr(27) || '[34m</a>' || chr(27) || '[0m' AS shown FROM part")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.render.html import highlighted_column

    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), highlighted_column(F.concat(F.lit('<a href="/x">'), "p_name", F.lit("</a>"))).alias("shown"))


_PREVIEW = document(("m", "p_partkey % 2 = 0", "Let \\( \\alpha^{2} \\) be.\n\n"), ("d", "p_partkey % 3 = 0", "\\[ x \\in \\mathbb{R} \\]\n\n"), END)


@BOOK.add("snk10_preview", f"SELECT {DOC}, {_PREVIEW.text_sql({'m': _lit('Let α² be.' + chr(10) * 2), 'd': _lit('x ∈ ℝ' + chr(10) * 2)})} AS text FROM part")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mathematics as Unicode in its place: bodies translated, then one splice a document."""
    from glyphlake.tex.translate import previewed

    return previewed(_PREVIEW.docs(spark, sf_dir))


@BOOK.add("snk12_translation_notes", f"SELECT {DOC}, 'p' || CAST(p_partkey AS VARCHAR) || '.md: note: frac has no unambiguous Unicode form' AS note FROM part WHERE p_partkey % 2 = 0")
def snk12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.translate import notes, translate

    body = F.when(F.col("p_partkey") % 2 == 0, F.lit(r"\frac{a}{b}")).otherwise(F.lit(r"\alpha"))
    return notes(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), translate(body, "unicode").alias("x")))


# The rules in their order, with D on by default and A advisory, as fixed values.
_CATALOGUE = (
    "unbalanced-backtick D, math/unbalanced-delim D, math/unbalanced-env D, math/unbalanced-braces D, math/render-compat, adjacent-code-no-space D, heading-punctuation D, orphan-reference-link D, duplicate-link-label D, bare-url D, "
    "trailing-whitespace D, inconsistent-list-marker D, table-pipe-spacing D, list-tightness-flipped A, duplicate-heading DA, unicodeable-subscript DA, info-string-typo DA, stray-dollar, latex-command, escaped-emphasis, subscript-damage"
)
_ROWS = [(k, (x + " ").split(" ")[0], (x + " ").split(" ")[1]) for k, x in enumerate(_CATALOGUE.split(", "))]


@BOOK.add("snk13_rule_catalogue", " UNION ALL ".join(f"SELECT {k} AS ord, '{n}' AS name, {'D' in f} AS is_default, {'A' in f} AS is_advisory" for k, n, f in _ROWS))
def snk13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark).select("ord", "name", "is_default", "is_advisory")


@BOOK.add("snk13_explain", " UNION ALL ".join(f"SELECT '{n}' AS name, {'D' in f} AS on_by_default FROM region WHERE r_regionkey = 0" for _, n, f in _ROWS))
def snk13_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import explain

    return spark.createDataFrame([(n, "on by default" in explain(n)) for _, n, _ in _ROWS], "name string, on_by_default boolean")


@BOOK.add("snk13_default_config", "SELECT TRUE AS same, TRUE AS formats_alike")
def snk13_default_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated configuration reads back as the defaults it spells."""
    read = config.load(config.default_toml())
    return spark.createDataFrame([(read == config.Config(), read.fmt == config.Fmt())], "same boolean, formats_alike boolean")
