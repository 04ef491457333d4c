"""Every lint rule over the derived documents, suppression, fixes, totals and output forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.operators.fixtures import Expect, expected_rows, markdown_docs, placed_sql
from glyphlake.rules.run import RuleSet, compact, diagnostics, exit_status, fixed, json_lines, left_after_fixes, select, totals
from glyphlake.rules.stdlib import RULES

Query = Callable[[SparkSession, str], DataFrame]
_KL = "length(CAST(p_partkey AS VARCHAR))"

EXPECTED: dict[str, list[Expect]] = {
    "unbalanced-backtick": [Expect("tick", "2", "1", "3")],
    "math/unbalanced-delim": [Expect("delim", "5", "2", "6")],
    "math/unbalanced-env": [Expect("env", "0", "13", "1")],
    "math/unbalanced-braces": [Expect("braces", "2", "1", "3")],
    "math/render-compat": [Expect("render", "3", "3", "4"), Expect("render", "12", "7", "13")],
    "adjacent-code-no-space": [Expect("adj", "5", "0", "6")],
    "heading-punctuation": [Expect("h1", f"7 + {_KL}", "1", f"8 + {_KL}", when="p_partkey % 4 = 0")],
    "orphan-reference-link": [Expect("orphan", "5", f"12 + {_KL}", "6")],
    "duplicate-link-label": [Expect("defs", "8", "7", "1", 1)],
    "bare-url": [Expect("url", "4", f"14 + {_KL}", "5")],
    "trailing-whitespace": [Expect("trail", "14", "1", "15")],
    "inconsistent-list-marker": [Expect("list", "12", "1", "1", 2)],
    "table-pipe-spacing": [Expect("table", "3", "0", "4")],
    "list-tightness-flipped": [],
    "duplicate-heading": [Expect("h2b", "3", "5", "4")],
    "unicodeable-subscript": [Expect("sub", "6", "4", "7")],
    "info-string-typo": [Expect("fence", "0", "9", "1", when="p_partkey % 14 = 0")],
    "stray-dollar": [Expect("dollar", "9", "1", "10"), Expect("supp", "93", "1", "5", 6)],
    "latex-command": [Expect("latex", "5", "6", "6")],
    "escaped-emphasis": [Expect("esc", "4", "2", "5")],
    "subscript-damage": [Expect("star", "6", "3", "7")],
}
_COLUMNS = ["doc_id", "rule", "line", "col", "span_start", "span_end"]


def _one(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diagnostics(markdown_docs(spark, sf_dir), RuleSet([RULES[name]])).where(F.col("rule") == name).select(_COLUMNS)

    return query


def _empty() -> str:
    return "SELECT CAST(0 AS BIGINT) AS doc_id, '' AS rule, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS col, CAST(0 AS BIGINT) AS span_start, CAST(0 AS BIGINT) AS span_end WHERE FALSE"


_FAULTS = {f"lnt{k:02d}_{name.replace('/', '_').replace('-', '_')}": name for k, name in enumerate(RULES, 1)}
QUERIES: dict[str, Query] = {key: _one(name) for key, name in _FAULTS.items()}
ORACLE: dict[str, str] = {key: f"WITH {placed_sql()} {expected_rows(name, EXPECTED[name]) if EXPECTED[name] else _empty()}" for key, name in _FAULTS.items()}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_DEFAULT = [n for n, r in RULES.items() if r.default]
_ALL_DEFAULT = " UNION ALL ".join(expected_rows(n, EXPECTED[n], f", {str(RULES[n].advisory).upper()} AS advisory") for n in _DEFAULT if EXPECTED[n])
_UNKNOWN = expected_rows("suppression", [Expect("unknown", "0", "35", "1")], ", TRUE AS advisory")


@query("lnt22_unknown_suppression", f"WITH {placed_sql()} {expected_rows('suppression', [Expect('unknown', '0', '35', '1')])}")
def lnt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(markdown_docs(spark, sf_dir), select("none,+stray-dollar")).where("rule = 'suppression'").select(_COLUMNS)


@query("run01_default_rules", f"WITH {placed_sql()} {_ALL_DEFAULT} UNION ALL {_UNKNOWN}")
def run01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(markdown_docs(spark, sf_dir)).select(*_COLUMNS, "advisory")


@query("run04_without_suppression", f"WITH {placed_sql()} {expected_rows('stray-dollar', [*EXPECTED['stray-dollar'], Expect('supp', '43', '1', '7', 2)])}")
def run04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(markdown_docs(spark, sf_dir), select("none,+stray-dollar"), suppress=False).select(_COLUMNS)


@query("sel01_rule_dsl", f"WITH {placed_sql()} {expected_rows('escaped-emphasis', EXPECTED['escaped-emphasis'])} UNION ALL {expected_rows('heading-punctuation', EXPECTED['heading-punctuation'])}")
def sel01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(markdown_docs(spark, sf_dir), select("none,+escaped-emphasis,+heading-punctuation,bare-url,-bare-url"), suppress=False).select(_COLUMNS)


@query(
    "agg01_totals",
    f"WITH {placed_sql()}, x AS ({_ALL_DEFAULT} UNION ALL {_UNKNOWN}) SELECT count(*) AS n_diagnostics, count(*) FILTER (WHERE NOT advisory) AS n_failing, "
    f"count(*) FILTER (WHERE rule IN ({', '.join(repr(n) for n, r in RULES.items() if r.fixes == 'safe')})) AS n_fixable FROM x",
)
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(diagnostics(markdown_docs(spark, sf_dir), locate=False))


@query(
    "agg15_exit_status",
    f"WITH {placed_sql()}, x AS ({_ALL_DEFAULT}) SELECT CAST(CASE WHEN count(*) FILTER (WHERE NOT advisory) > 0 THEN 1 ELSE 0 END AS INTEGER) AS status FROM x",
)
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg01(spark, sf_dir).select(exit_status(F.col("n_failing"), F.lit(0), True).alias("status"))


@query("agg04_findings_by_rule", f"WITH {placed_sql()}, x AS ({_ALL_DEFAULT} UNION ALL {_UNKNOWN}) SELECT rule, count(*) AS n FROM x GROUP BY rule")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(markdown_docs(spark, sf_dir), locate=False).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _fixed_sql() -> str:
    """The text with each slot in its fixed form."""
    from glyphlake.operators.fixtures import K, SLOTS, _join, _lit

    new = {
        "h1": _join(_lit("# Part "), K, _lit("\n\n")), "sub": _lit("Area x² here.\n\n"), "url": _join(_lit("See <http://ex.org/"), K, _lit(">. More\n\n")), "adj": _lit("Use x `y` now.\n\n"),
        "trail": _lit("Trailing blank\n\n"), "list": _lit("- one\n- two\n- three\n\n"), "table": _lit("| a | b |\n|--:|---|\n| 1 | 2 |\n\n"),
    }
    return " || ".join(f"CASE WHEN {cond} THEN {new.get(name, text)} ELSE '' END" for name, cond, text in SLOTS)


@query("fix01_safe_fixes", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_fixed_sql()} AS text FROM part")
def fix01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)
    return fixed(docs, diagnostics(docs, locate=False)).select("doc_id", "text")


@query("fix03_fix_then_lint", f"WITH {placed_sql()}, x AS ({_ALL_DEFAULT} UNION ALL {_UNKNOWN}) SELECT rule, count(*) AS n FROM x WHERE rule NOT IN ({', '.join(repr(n) for n, r in RULES.items() if r.fixes == 'safe')}) GROUP BY rule")
def fix03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_after_fixes(markdown_docs(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("snk05_compact", f"WITH {placed_sql()}, x AS ({expected_rows('heading-punctuation', EXPECTED['heading-punctuation'])}) SELECT 'p' || doc_id || '.md:' || line || ':' || col || ': heading-punctuation: heading ends in .' AS value FROM x")
def snk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics(markdown_docs(spark, sf_dir), select("none,+heading-punctuation"), suppress=False)
    return compact(found.withColumn("path", F.concat(F.lit("p"), "doc_id", F.lit(".md"))))


@query(
    "snk03_json_lines",
    f"""WITH {placed_sql()}, x AS ({expected_rows('heading-punctuation', EXPECTED['heading-punctuation'])}) SELECT '{{"schema_version":2,"path":"p' || doc_id || '.md","severity":"warning","rule":{{"name":"heading-punctuation",'
    || '"description":"A heading that ends in a full stop or colon","url":"https://lint.example/rules/heading-punctuation.html"}},"source":{{"line":' || line || ',"column":' || col || ',"span_start":' || span_start
    || ',"span_end":' || span_end || ',"snippet":"."}},"message":"heading ends in .","fix":{{"replacement":"","safe":true}}}}' AS value FROM x""",
)
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)
    found = diagnostics(docs, select("none,+heading-punctuation"), suppress=False).withColumn("path", F.concat(F.lit("p"), "doc_id", F.lit(".md")))
    return json_lines(found, docs, "https://lint.example")
