"""Formulas that stand as code, turned into mathematics: classify, translate, edit; with a log of what was left and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts
from glyphlake.operators.ranges import outside, require_disjoint
from glyphlake.tex import registry as R
from glyphlake.tex.translate import translate

_SYMBOLS = "".join(sorted({c for c in [*R.COMMANDS, *R.UNSUPER, *R.UNSUB, *R.FROM_ALPHABET, "√"] if not c.isascii()}))
_SIGNAL = rf"[{_SYMBOLS}]|\\[A-Za-z]+|[A-Za-z0-9)}}][\^_]\{{|[A-Za-z0-9)]\^[A-Za-z0-9(]"
_DIAGRAM = r"[\u2500-\u257f\u2580-\u259f↗↘↙↖]|[-=]{4,}"
_PROSE = r"(?:\b[A-Za-z]?[a-z]{3,}\b[^A-Za-z\\]*){2,}"


def code_class(text: Column) -> Column:
    """formula, label (a short one in capitals), diagram, prose (words, or words around a formula), or code."""
    bare = F.regexp_replace(text, r"\\[A-Za-z]+", "")
    return (
        F.when(text.rlike(_DIAGRAM), "diagram").when(text.rlike(r"^\s*[A-Z0-9_-]{1,4}\s*$"), "label").when(bare.rlike(_PROSE), "prose")
        .when(text.rlike(_SIGNAL), "formula").otherwise("code")
    )


def _plain_info(info: Column) -> Column:
    return T.ascii_lower(T.first_word(F.coalesce(info, F.lit("")))).isin("", "text", "txt", "plain", "math")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All code outside mathematics as (doc_id, s, e, block, class, latex), and the documents as they were parsed."""
    facts = Facts(docs, ["inline_codes", "code_blocks", "math_regions"], share=True)
    spans = facts.table("inline_codes").select("doc_id", "s", "e", "text", F.lit(False).alias("block"), code_class(F.col("text")).alias("class"))
    blocks = facts.table("code_blocks")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    whole = F.when(F.size(lines) == 0, "code").when(F.forall(lines, lambda x: code_class(x) == "formula"), "formula").otherwise(F.element_at(F.filter(F.transform(lines, code_class), lambda c: c != "formula"), 1))
    kind = F.when(~_plain_info(F.col("label")), "language").otherwise(whole)
    blocks = blocks.select("doc_id", "s", "e", "text", F.lit(True).alias("block"), kind.alias("class"))
    rows = outside(spans.unionByName(blocks), facts.table("math_regions"))
    latex = translate(F.trim("text"), "latex")["text"]
    rows = rows.withColumn("latex", F.when(F.col("class") == "formula", latex))
    rows = rows.withColumn("class", F.when((F.col("class") == "formula") & F.col("latex").rlike(r"[^\x00-\x7f]"), "untranslatable").otherwise(F.col("class")))
    return rows, facts.docs


def migrated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, n_edits) with formulas in place of code, and the log (doc_id, s, e, class) of what stayed.

    Edits that overlap fail the job: they would mean that the parse is wrong.
    """
    rows, parsed = candidates(docs)
    new = F.when(F.col("block"), F.concat(F.lit("\\[\n"), "latex", F.lit("\n\\]"))).otherwise(F.concat(F.lit("\\("), "latex", F.lit("\\)")))
    edits = require_disjoint(rows.where("class = 'formula'").select("doc_id", "s", "e", new.alias("r")))
    edits = edits.groupBy("doc_id").agg(F.collect_list(F.struct("s", F.lit(0).alias("ord"), "e", "r")).alias("edits"))
    none = F.expr("cast(array() as array<struct<s:int,ord:int,e:int,r:string>>)")
    out = parsed.join(edits, "doc_id", "left").withColumn("edits", F.coalesce(T.greedy_from_the_end(F.col("edits")), none))
    out = out.select("doc_id", T.splice(F.col("text"), F.col("edits")).alias("text"), F.size("edits").alias("n_edits"))
    return out, rows.where("class <> 'formula'").select("doc_id", "s", "e", "class")
