"""Parsing, text functions, joins, formatting, TeX, corpora and streams, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.fmt.engine import format_report, formatted
from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts, canonical, lines_of, located
from glyphlake.operators.fixtures import SLOTS, Expect, K, _join, _lit, expected_rows, markdown_docs, placed_sql
from glyphlake.queries.lint import _KL, EXPECTED, _empty
from glyphlake.rules.run import suppressed_ranges
from glyphlake.sources.config import Fmt
from glyphlake.sources.corpus import changed
from glyphlake.sources.scratch import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RENDER, _BRACES = len("\\( \\ce{H} + \\nosuch \\)"), len("\\( \\beta {x \\)")
FACTS: dict[str, tuple[str, list[Expect]]] = {
    "prs09_headings": ("headings", [Expect("h1", "2", f"5 + {_KL} + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END", "3"), Expect("h2", "3", "5", "4"), Expect("h2b", "3", "5", "4")]),
    "prs13_frontmatter": ("frontmatter", [Expect("front", "0", f"17 + {_KL}", "1")]),
    "prs08_inline_codes": ("inline_codes", [Expect("adj", "5", "3", "6")]),
    "prs06_code_blocks": ("code_blocks", [Expect("fence", "0", "22", "1")]),
    "prs36_thematic_breaks": ("thematic_breaks", [Expect("rule", "0", "3", "1")]),
    "prs36_list_items": ("list_items", [*(Expect("list", str(6 * k), "1", "1", k) for k in range(3)), *(Expect("ol", str(5 * k), "2", "1", k) for k in range(2))]),
    "prs10_list_groups": ("list_groups", [Expect("list", "0", "11", "1"), Expect("list", "12", "7", "1", 2), Expect("ol", "0", "9", "1")]),
    "prs18_link_definitions": ("link_defs", [Expect("defs", "0", "7", "1"), Expect("defs", "8", "7", "1", 1)]),
    "prs28_tables": ("tables", [Expect("table", "0", "28", "1")]),
    "prs28_table_cells": ("table_cells", [Expect("table", "2", "1", "3"), Expect("table", "5", "1", "6"), Expect("table", "10", "3", "2", 1), Expect("table", "14", "3", "6", 1), Expect("table", "21", "1", "3", 2), Expect("table", "25", "1", "7", 2)]),
    "prs23_autolinks": ("autolinks", [Expect("url", "4", f"14 + {_KL}", "5"), Expect("mail", "9", f"8 + {_KL}", "10")]),
    "prs35_emphasis": ("emphasis", [Expect("em", "5", "6", "6"), Expect("em", "16", "8", "17")]),
    "prs14_suppressions": ("suppressions", [Expect("supp", "0", "35", "1"), Expect("supp", "53", "34", "1", 4), Expect("unknown", "0", "35", "1")]),
    "prs17_link_like": ("link_like", [Expect("defs", "0", "7", "1"), Expect("defs", "8", "7", "1", 1)]),
    "mth01_regions": ("math_regions", [Expect("braces", "0", str(_BRACES), "1"), Expect("render", "0", str(_RENDER), "1")]),
    "mth01_errors": ("math_errors", [*EXPECTED["math/unbalanced-braces"], *EXPECTED["math/unbalanced-delim"], *EXPECTED["math/unbalanced-env"]]),
    "prs05_parse_errors": ("parse_errors", []),
}


def _fact(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = Facts(markdown_docs(spark, sf_dir), [name])
        rows = located(facts.table(name), facts.docs)
        return rows.select("doc_id", F.lit(name).alias("rule"), *(F.col(a).cast("long").alias(b) for a, b in (("line", "line"), ("col", "col"), ("s", "span_start"), ("e", "span_end"))))

    return run


for _key, (_name, _expects) in FACTS.items():
    QUERIES[_key] = _fact(_name)
    ORACLE[_key] = f"WITH {placed_sql()} {expected_rows(_name, _expects) if _expects else _empty()}"


@query(
    "prs03_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''),
    p AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
    SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(s AS BIGINT) AS s, CAST(s + strlen(t) AS BIGINT) AS e, md5(t) AS digest FROM p WHERE line < n OR t <> ''""",
)
def prs03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line", "s", "e")), F.md5("text").alias("digest"))


_RAW = f"'a' || chr(13) || chr(10) || {K} || chr(13) || 'c' || chr(10)"


@query("prs01_canonical", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'a' || chr(10) || {K} || chr(10) || 'c' || chr(10) AS text FROM part")
def prs01(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{_RAW.replace('VARCHAR(20)', 'STRING')} AS text")
    return raw.select("doc_id", canonical().alias("text"))


@query("prs19_labels", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'the part ' || {K} || ' x' AS label FROM part")
def prs19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), T.normal_label(F.concat(F.lit(" The \t PART\n"), F.col("p_partkey").cast("string"), F.lit("\u00a0 X "))).alias("label"))


@query("prs24_emails", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def prs24(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"), F.lit(0))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(hits).cast("long").alias("n"))


_FILTERED = "title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext"


@query("prs26_tagfilter", rf"SELECT page_id, md5(regexp_replace(html, '(?i)<(/?(?:{_FILTERED})(?:\s|>|/))', '&lt;\1', 'g')) AS digest FROM pages")
def prs26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace("html", rf"(?i)<(?=/?(?:{_FILTERED})(?:\s|>|/))", "&lt;")).alias("digest"))


@query(
    "str01_positions",
    """WITH g AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+tion') AS m, regexp_split_to_array(text, '[a-z]+tion') AS g FROM documents),
    i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM g)
    SELECT doc_id, CAST(strlen(array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '')) AS BIGINT) AS s, m[i] AS word FROM i""",
)
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.explode(T.matches(F.col("text"), "[a-z]+tion")).alias("x"))
    return hits.select("doc_id", F.col("x.s").cast("long").alias("s"), F.col("x.m").alias("word"))


@query(
    "str02_scalars",
    r"""SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = text AS is_lower, CAST(length(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.,;:!?]+$', '')) AS BIGINT) AS n_trimmed,
    CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars, md5(replace(text, chr(10), chr(92) || 'n')) AS one_line, string_split(text, ' ')[1] AS first_word,
    CAST((length(text) - length(replace(text, ' the ', ''))) // 5 AS BIGINT) AS n_the FROM documents""",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", (T.ascii_lower(t) == t).alias("is_lower"), F.length(T.trim_punctuation(T.collapse(t))).cast("long").alias("n_trimmed"), F.octet_length(t).cast("long").alias("n_bytes"),
        F.length(t).cast("long").alias("n_chars"), F.md5(T.one_line(t)).alias("one_line"), F.split(t, " ")[0].alias("first_word"), T.occurrences(t, " the ").alias("n_the"),
    )


@query("str20_jaro_winkler", "SELECT n_name AS name, max_by(r_name, struct_pack(s := jaro_winkler_similarity(n_name, r_name), r := r_name)) AS nearest, round(max(jaro_winkler_similarity(n_name, r_name)), 6) AS score FROM nation, region GROUP BY n_name")
def str20(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = F.broadcast(table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("all")))  # five rows, a fixed table
    rows = table(spark, sf_dir, "nation").join(regions).select("n_name", F.explode("all").alias("r_name"))
    rows = rows.withColumn("score", T.similarity("n_name", "r_name"))
    best = rows.groupBy(F.col("n_name").alias("name")).agg(F.max(F.struct("score", "r_name")).alias("x"))
    return best.select("name", F.col("x.r_name").alias("nearest"), F.round("x.score", 6).alias("score"))


@query("str13_display_width", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(5 + 2 * {_KL} AS INTEGER) AS width FROM part")
def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("e\u0301 漢"), F.lit("x"), F.repeat(F.lit("字"), F.length(F.col("p_partkey").cast("string")))).alias("t"))
    return rows.select("doc_id", T.display_width("t").alias("width"))


@query("run03_suppressed_ranges", f"WITH {placed_sql()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'stray-dollar' AS rule, CAST(o_supp + 35 AS BIGINT) AS s, CAST(o_supp + 53 AS BIGINT) AS e FROM o WHERE p_partkey % 19 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'no-such-rule', CAST(o_unknown + 35 AS BIGINT), CAST(2147483647 AS BIGINT) FROM o WHERE p_partkey % 23 = 0")
def run03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppressed_ranges(Facts(markdown_docs(spark, sf_dir), ["suppressions"])).select("doc_id", "rule", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def _text_sql(new: dict[str, str]) -> str:
    return "SELECT CAST(p_partkey AS BIGINT) AS doc_id, " + " || ".join(f"CASE WHEN {c} THEN {new.get(n, t)} ELSE '' END" for n, c, t in SLOTS) + " AS text FROM part"


_TABLE = _lit("| a | b |\n| --: | --- |\n| 1 | 2 |\n\n")
FORMATS: dict[str, tuple[Fmt, dict[str, str]]] = {
    "fmt08_tables_compact": (Fmt(), {"table": _TABLE}),
    "fmt09_tables_align": (Fmt(tables_style="align"), {"table": _lit("|   a | b   |\n| --: | --- |\n|   1 | 2   |\n\n")}),
    "fmt01_italic": (Fmt(italic="asterisk"), {"table": _TABLE, "em": _lit("Some *soft* and __hard__ words.\n\n")}),
    "fmt02_strong": (Fmt(strong="asterisk"), {"table": _TABLE, "em": _lit("Some _soft_ and **hard** words.\n\n")}),
    "fmt04_ordered_one": (Fmt(ordered_list="one"), {"table": _TABLE, "ol": _lit("3. c\n3. d\n\n")}),
    "fmt04_ordered_consistent": (Fmt(ordered_list="consistent"), {"table": _TABLE, "ol": _lit("3. c\n4. d\n\n")}),
    "fmt05_thematic_break": (Fmt(thematic_break="underscore-70"), {"table": _TABLE, "rule": _lit("_" * 70 + "\n\n")}),
    "fmt06_references": (Fmt(refs_style="angle"), {"table": _TABLE, "defs": _lit("[a]: </1>\n[A]: </2>\n\n")}),
    "fmt10_math_dollar": (Fmt(math_render="dollar", tables_style="preserve"), {"braces": _lit("$\\beta {x$\n\n"), "render": _lit("$\\ce{H} + \\nosuch$\n\n")}),
    "fmt11_frontmatter": (Fmt(frontmatter_preserve=False), {"table": _TABLE, "front": "''"}),
    "fmt18_strip_newline": (Fmt(trailing_newline="strip", tables_style="preserve"), {"end": "'The end.'"}),
    "fmt31_identity": (Fmt(tables_style="preserve"), {}),
}


def _format(options: Fmt) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return formatted(markdown_docs(spark, sf_dir), options).select("doc_id", F.col("formatted").alias("text"))

    return run


for _key, (_options, _new) in FORMATS.items():
    QUERIES[_key], ORACLE[_key] = _format(_options), _text_sql(_new)


@query("fmt13_wrap")
def fmt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "documents"), Fmt(wrap=80)).select("doc_id", "formatted", "changed")


@query("fmt29_stable", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, TRUE AS stable, TRUE AS converged FROM part")
def fmt29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(markdown_docs(spark, sf_dir), Fmt(wrap=20, tables_style="align", italic="asterisk"), check=True).select("doc_id", "stable", "converged")


@query("agg03_format_report", "SELECT count(*) AS n_docs, count(*) FILTER (WHERE p_partkey % 18 = 0) AS n_changed, CAST(3 * count(*) FILTER (WHERE p_partkey % 18 = 0) AS BIGINT) - count(*) FILTER (WHERE p_partkey % 18 = 0) AS n_proposed, CAST(2 * count(*) FILTER (WHERE p_partkey % 18 = 0) AS BIGINT) AS n_applied, CAST(0 AS BIGINT) AS n_rejected, CAST(0 AS BIGINT) AS n_not_converged FROM part")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_report(formatted(markdown_docs(spark, sf_dir)))


@query("snk02_diff", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_join(_lit('--- a/p.md'), 'chr(10)', _lit('+++ b/p.md'), 'chr(10)')} AS head FROM part WHERE p_partkey % 18 = 0")
def snk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)
    new = formatted(docs).where("changed").select("doc_id", "formatted")
    rows = docs.join(new, "doc_id").select("doc_id", T.unified_diff(F.lit("p.md"), F.col("text"), F.col("formatted")).alias("diff"))
    return rows.select("doc_id", F.regexp_extract("diff", r"^(--- a/p\.md\n\+\+\+ b/p\.md\n)@@ ", 1).alias("head"))


@query("cor01_changed_documents", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, FALSE AS same_length FROM part WHERE p_partkey % 18 = 0 UNION ALL SELECT CAST(-p_partkey AS BIGINT), FALSE FROM part WHERE p_partkey % 50 = 0")
def cor01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)
    new = formatted(docs).select("doc_id", F.col("formatted").alias("text"))
    more = docs.where("doc_id % 50 = 0").select((-F.col("doc_id")).alias("doc_id"), "text")
    return changed(docs.unionByName(more), new).select("doc_id", F.coalesce(F.length("old") == F.length("new"), F.lit(False)).alias("same_length"))


@query("cor11_largest_documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents ORDER BY n_bytes DESC, doc_id LIMIT 10")
def cor11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).orderBy(F.desc("n_bytes"), "doc_id").limit(10)


@query("cor15_needles", "SELECT source, CAST(sum(length(text) - length(replace(text, '$', ''))) AS BIGINT) AS dollars, CAST(sum(length(text) - length(replace(text, '#', ''))) AS BIGINT) AS hashes FROM documents GROUP BY source")
def cor15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.sum(T.occurrences(F.col("text"), "$")).alias("dollars"), F.sum(T.occurrences(F.col("text"), "#")).alias("hashes"))


_FORM = "CASE WHEN p_partkey % 2 = 0 THEN chr(92) || 'frac{a}{' ELSE '√{' END"


@query("tex08_to_unicode", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_join(_FORM, K)} || '}} ≤ α² ∈ ℝ' AS text, CASE WHEN p_partkey % 2 = 0 THEN 'lossy' ELSE 'lossless' END AS status FROM part")
def tex08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.translate import translate

    start = F.when(F.col("p_partkey") % 2 == 0, F.lit(r"\frac{a}{")).otherwise(F.lit(r"\sqrt{{"))
    end = F.when(F.col("p_partkey") % 2 == 0, F.lit("}")).otherwise(F.lit("}}"))
    body = F.concat(start, F.col("p_partkey").cast("string"), end, F.lit(r" \leq \alpha^{2} \in \mathbb{R}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), translate(body, "unicode").alias("x")).select("doc_id", "x.text", "x.status")


@query("tex09_to_latex", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_join(K, _lit(chr(92) + 'alpha^{2}' + chr(92) + 'leq x_{10}'))} AS text FROM part")
def tex09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.translate import translate

    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), translate(F.concat(F.col("p_partkey").cast("string"), F.lit("α²≤x₁₀")), "latex").alias("x")).select("doc_id", "x.text")


@query("tex14_command_events", f"WITH {placed_sql()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'command' AS what, 'ce' AS name, CAST(o_render + 3 AS BIGINT) AS s FROM o WHERE p_partkey % 15 = 3 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'command', 'nosuch', CAST(o_render + 12 AS BIGINT) FROM o WHERE p_partkey % 15 = 3 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'command', 'beta', CAST(o_braces + 3 AS BIGINT) FROM o WHERE p_partkey % 15 = 0")
def tex14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.render import command_events

    rows = command_events(Facts(markdown_docs(spark, sf_dir), ["math_regions"]).table("math_regions"))
    return rows.select("doc_id", "what", "name", F.col("s").cast("long").alias("s"))


_EDITS = "CAST(user_id % 97 AS VARCHAR) AS uri, CAST((event_id * 31) % 1009 AS BIGINT) AS version, ts AS arrival"


def edit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as edits: users stand for documents; versions jump, so that some edits come late."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.select((F.col("user_id") % 97).cast("string").alias("uri"), (F.col("event_id") * 31 % 1009).cast("long").alias("version"), F.lit("change").alias("kind"), F.concat(F.lit("# Edit "), F.col("event_id").cast("string"), F.lit(".\n")).alias("text"), F.col("ts").alias("arrival"))


@query(
    "stm03_debounce",
    f"""WITH e AS (SELECT {_EDITS} FROM events), g AS (SELECT *, CASE WHEN arrival < lag(arrival) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY uri ORDER BY arrival, version)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY arrival, version) AS burst FROM g)
    SELECT uri, max(version) AS version, count(*) AS n_edits FROM b GROUP BY uri, burst""",
)
def stm03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.streaming.editing import debounced, run_to_end

    return run_to_end(debounced(edit_stream(spark, sf_dir), "1 hour"), shared_dir(spark), "complete").select("uri", "version", "n_edits")


@query(
    "stm04_stale_versions",
    f"""WITH e AS (SELECT {_EDITS} FROM events), m AS (SELECT *, max(version) OVER (PARTITION BY uri ORDER BY arrival, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT uri, version, 'open' AS status FROM m WHERE before IS NULL OR version >= before""",
)
def stm04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.streaming.editing import accepted, run_to_end

    return run_to_end(accepted(edit_stream(spark, sf_dir)), shared_dir(spark)).select("uri", "version", "status")


def parsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of all documents, as a written table: what several rules would share."""
    from glyphlake.operators.facts import ALL_FACTS, parse_facts

    return written(parse_facts(table(spark, sf_dir, "documents"), ALL_FACTS), "facts")


@query("prs04_all_facts")
def prs04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_once(spark, sf_dir).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))
