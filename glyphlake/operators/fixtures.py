"""Markdown documents derived from ``part``: a fixed row of slots, each present by a rule on the key.

The same SQL makes the texts in Spark and the expectations in the oracle: an expectation is a slot, a condition and an
offset in it, so the oracle computes places from the recipe and never reads the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from glyphlake.sources.scratch import spread

K = "CAST(p_partkey AS VARCHAR(20))"
NL = "chr(10)"


def _join(*parts: str) -> str:
    return " || ".join(parts)


def _lit(text: str) -> str:
    """A string literal without backslashes or line breaks inside, which the two dialects read differently."""
    out, run = [], ""
    for c in text:
        if c in "\n\\":
            if run:
                out.append("'" + run.replace("'", "''") + "'")
            out.append(f"chr({ord(c)})")
            run = ""
        else:
            run += c
    if run or not out:
        out.append("'" + run.replace("'", "''") + "'")
    return " || ".join(out)


SLOTS: list[tuple[str, str, str]] = [
    ("front", "p_partkey % 11 = 0", _join(_lit("---\ntitle: p"), K, _lit("\n---\n"))),
    ("h1", "TRUE", _join(_lit("# Part "), K, "CASE WHEN p_partkey % 4 = 0 THEN '.' ELSE '' END", _lit("\n\n"))),
    ("note", "TRUE", _join(_lit("Café note "), K, _lit(" of "), "p_brand", _lit(" 漢字.\n\n"))),
    ("dollar", "p_partkey % 5 = 0", _lit("It costs $7 today.\n\n")),
    ("esc", "p_partkey % 6 = 0", _lit("An a\\_b name.\n\n")),
    ("sub", "p_partkey % 7 = 0", _lit("Area x^{2} here.\n\n")),
    ("url", "p_partkey % 3 = 0", _join(_lit("See http://ex.org/"), K, _lit(". More\n\n"))),
    ("orphan", "p_partkey % 3 = 1", _join(_lit("Read [this][nope"), K, _lit("] now.\n\n"))),
    ("tick", "p_partkey % 13 = 0", _lit("A ` tick.\n\n")),
    ("adj", "p_partkey % 8 = 0", _lit("Use x`y` now.\n\n")),
    ("trail", "p_partkey % 9 = 0", _lit("Trailing blank \n\n")),
    ("fence", "p_partkey % 2 = 0", _join("'```'", "CASE WHEN p_partkey % 14 = 0 THEN 'pyhton' ELSE 'python' END", _lit("\ncode $5 \n```\n\n"))),
    ("list", "p_partkey % 10 = 0", _lit("- one\n- two\n* three\n\n")),
    ("h2", "TRUE", _lit("## Notes\n\n")),
    ("h2b", "p_partkey % 5 = 1", _lit("## notes\n\n")),
    ("latex", "p_partkey % 12 = 0", _lit("Take \\alpha in text.\n\n")),
    ("braces", "p_partkey % 15 = 0", _lit("\\( \\beta {x \\)\n\n")),
    ("delim", "p_partkey % 15 = 1", _lit("Open \\( x here.\n\n")),
    ("env", "p_partkey % 15 = 2", _lit("\\begin{align} x\n\n")),
    ("render", "p_partkey % 15 = 3", _lit("\\( \\ce{H} + \\nosuch \\)\n\n")),
    ("star", "p_partkey % 16 = 0", _lit("Value x*y here.\n\nHead f*z here.\n\n")),
    ("defs", "p_partkey % 17 = 0", _lit("[a]: /1\n[A]: /2\n\n")),
    ("table", "p_partkey % 18 = 0", _lit("| a| b |\n|--:|---|\n| 1 | 2 |\n\n")),
    ("supp", "p_partkey % 19 = 0", _lit("<!-- lint: disable stray-dollar -->\n\nStill $9 here.\n\n<!-- lint: enable stray-dollar -->\n\nNow $8 again.\n\n")),
    ("unknown", "p_partkey % 23 = 0", _lit("<!-- lint: disable no-such-rule -->\n\n")),
    ("mail", "p_partkey % 29 = 0", _join(_lit("Write to p"), K, _lit("@ex.org today.\n\n"))),
    ("em", "p_partkey % 31 = 0", _lit("Some _soft_ and __hard__ words.\n\n")),
    ("rule", "p_partkey % 37 = 0", _lit("***\n\n")),
    ("ol", "p_partkey % 41 = 0", _lit("3. c\n7. d\n\n")),
    ("end", "TRUE", _lit("The end.\n")),
]


class Recipe:
    """Documents made of slots, one for each part, and the SQL that knows where everything in them lies."""

    def __init__(self, slots: list[tuple[str, str, str]]):
        self.slots = slots

    def docs(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(doc_id, text), one document per part."""
        part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"), 4)
        text = " || ".join(f"CASE WHEN {cond} THEN {sql.replace('VARCHAR(20)', 'STRING')} ELSE '' END" for _, cond, sql in self.slots)
        return part.selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"{text} AS text")

    def text_sql(self, new: dict[str, str] | None = None) -> str:
        """An SQL expression over ``part``: the text, with other content in some slots."""
        return " || ".join(f"CASE WHEN {cond} THEN {(new or {}).get(name, text)} ELSE '' END" for name, cond, text in self.slots)

    def placed(self) -> str:
        """CTEs: ``d`` with all slots, ``o`` with byte offsets o_x and line numbers l_x of each."""
        byte, line, cols = [], [], []
        for name, _, _ in self.slots:
            cols.append(f"{' + '.join(byte) or '0'} AS o_{name}, {' + '.join(line) or '0'} + 1 AS l_{name}")
            byte.append(f"strlen(t_{name})")
            line.append(f"(length(t_{name}) - length(replace(t_{name}, chr(10), '')))")
        slots = ", ".join(f"CASE WHEN {cond} THEN {text} ELSE '' END AS t_{name}" for name, cond, text in self.slots)
        return f"d AS (SELECT *, {slots} FROM part), o AS (SELECT *, {', '.join(cols)} FROM d)"

    def expected(self, rule: str, expects: list[Expect], extra: str = "") -> str:
        conds = {name: cond for name, cond, _ in self.slots}
        return " UNION ALL ".join(
            f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, '{rule}' AS rule, CAST(l_{x.slot} + {x.line} AS BIGINT) AS line, CAST({x.col} AS BIGINT) AS col, "
            f"CAST(o_{x.slot} + {x.at} AS BIGINT) AS span_start, CAST(o_{x.slot} + {x.at} + {x.length} AS BIGINT) AS span_end{extra if x.extra is None else ', ' + x.extra} "
            f"FROM o WHERE {conds[x.slot]} AND {x.when}"
            for x in expects
        )


@dataclass(frozen=True)
class Expect:
    """A finding in a slot: its line there, byte offset from the slot's start, length, and code point column."""

    slot: str
    at: str
    length: str
    col: str
    line: int = 0
    when: str = "TRUE"
    extra: str | None = None


BASE = Recipe(SLOTS)
markdown_docs, placed_sql, expected_rows = BASE.docs, BASE.placed, BASE.expected
