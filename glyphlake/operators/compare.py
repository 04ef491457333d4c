"""Two corpora side by side: differences, what they mean, and how a hand-kept table classifies them."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType

from glyphlake.fmt.engine import format_text, signature
from glyphlake.functions import text as T
from glyphlake.operators.facts import at_home, lines_of
from glyphlake.render.html import html_of
from glyphlake.sources.config import Fmt

FENCE = "`" * 32
STATUSES = ("fixed", "configured", "intentional-divergence", "upstream-parser-limitation", "open-bug")  # fixed values


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; equal ends are taken off first, rows are numpy arrays."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    m = 0
    while m < min(len(a), len(b)) and a[-1 - m] == b[-1 - m]:
        m += 1
    a, b = a[: len(a) - m], b[: len(b) - m]
    if not a or not b:
        return n + m
    number = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([number[x] for x in b])
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(step[1:], row[:-1] + (y == number[x]))
        row = np.maximum.accumulate(step)
    return n + m + int(row[-1])


@F.pandas_udf(IntegerType())
def common_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([lcs_length((a or "").splitlines(), (b or "").splitlines()) for a, b in zip(old, new, strict=True)])


def line_changes(pairs: DataFrame) -> DataFrame:
    """``pairs(…, old, new)`` with the number of lines deleted and inserted; a missing text has none."""
    count = lambda c: F.size(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n\z", ""), "\n", -1)) - F.when(F.coalesce(c, F.lit("")) == "", 1).otherwise(0)
    rows = pairs.withColumn("_common", common_lines("old", "new"))
    return rows.withColumns({"deleted": count(F.col("old")) - F.col("_common"), "inserted": count(F.col("new")) - F.col("_common")}).drop("_common")


def summary(pairs: DataFrame) -> DataFrame:
    return line_changes(pairs).agg(F.count(F.lit(1)).alias("changed_files"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted_lines"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted_lines"))


def normal_html(html: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(html, r"[ \t\n\r\f]+", " "), "^ | $", "")


def outcomes(pairs: DataFrame) -> DataFrame:
    """``pairs(doc_id, old, new)`` -> (doc_id, meaning, html): equivalent, drift, parse-error, or not-checked if one is missing."""

    def verdict(old: str | None, new: str | None, form) -> str:
        if old is None or new is None:
            return "not-checked"
        try:
            return "equivalent" if form(old) == form(new) else "drift"
        except (RecursionError, ValueError, IndexError, KeyError):
            return "parse-error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            said = [verdict(a, b, signature) for a, b in rows]
            html = [verdict(a, b, lambda t: " ".join(html_of(t).split())) for a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(html, pa.string())], names=["doc_id", "meaning", "html"])

    return pairs.select(F.col("doc_id").cast("long").alias("doc_id"), "old", "new").mapInArrow(run, "doc_id long, meaning string, html string")


def table_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of pipe tables in documents as (doc_id, ord, columns…), without heads and rules; short rows are skipped."""
    lines = lines_of(docs).where(F.ltrim("text").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "^`+|`+$", ""))
    rows = lines.select("doc_id", F.col("line").alias("ord"), cells.alias("c")).where(F.size("c") >= len(columns))
    rows = rows.where((F.lower(F.col("c")[0]) != columns[0].lower()) & ~F.forall("c", lambda c: c.rlike("^[-: ]*$")))
    return rows.select("doc_id", "ord", *(F.col("c")[k].alias(n) for k, n in enumerate(columns)))


def valid_status(rows: DataFrame) -> DataFrame:
    """The rows; one with a status that is none of ``STATUSES`` fails the job."""
    fail = F.raise_error(F.concat(F.lit("unknown status "), F.col("status"))).cast("boolean")
    return rows.where(F.when(F.col("status").isin(*STATUSES), F.lit(True)).otherwise(fail))


def path_keys(path: Column) -> Column:
    """Every pattern that matches a path: itself, ``*``, ``**``, and each folder above it (and itself) with ``/**``."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/**")))
    return F.array_distinct(F.concat(F.array(F.lit("*"), F.lit("**"), path), above))


def classify(differences: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences (corpus, path) with the first row (by ``ord``) whose corpus and path pattern match; and those that none matches.

    A path has as many patterns as folders, so the wildcard match is a lookup of them. The table is kept by hand, so it alone is
    broadcast, as one map; a difference finds its row where it is, and its patterns are never shuffled or sent to the driver.
    """
    named = rows.where("corpus is not null and pattern is not null").groupBy(F.struct("corpus", "pattern").alias("k")).agg(F.min(F.struct("ord", "status")).alias("v"))
    table = named.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_table"))
    keys = F.flatten(F.transform(F.array(F.col("corpus"), F.lit("*")), lambda c: F.transform("_keys", lambda p: F.struct(c.alias("corpus"), p.alias("pattern")))))
    hits = F.transform(keys, lambda k: F.try_element_at("_table", k))
    known = differences.withColumn("_keys", path_keys(F.col("path"))).join(F.broadcast(table)).withColumn("_row", F.array_min(hits)).drop("_table", "_keys")
    first = known.where("_row is not null").select("corpus", "path", "_row").distinct()
    return first.select("corpus", "path", F.col("_row.ord").alias("ord"), F.col("_row.status").alias("status")), known.where("_row is null").select(*differences.columns)


def matches_any(path: Column, patterns: list[str]) -> Column:
    return F.arrays_overlap(path_keys(path), F.array(*map(F.lit, patterns)))


def soak(docs: DataFrame, options: Fmt | None = None) -> DataFrame:
    """One row a document: its size, whether it parses, changes, keeps its meaning and is settled, and the seconds that took."""
    o = options or Fmt()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                start, text = time.perf_counter(), text or ""
                try:
                    once, _ = format_text(text, o)
                    rows.append((len(text.encode()), True, once != text, signature(once, False) == signature(text, False), format_text(once, o)[0] == once, time.perf_counter() - start))
                except (RecursionError, ValueError, IndexError):
                    rows.append((len(text.encode()), False, False, False, False, time.perf_counter() - start))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "parsed", "changed", "same", "settled", "seconds"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, parsed boolean, changed boolean, same boolean, settled boolean, seconds double")


def soak_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("n_bytes"), F.lit(0)).alias("largest"), *(F.count_if(~F.col(c)).alias(f"not_{c}") for c in ("parsed", "same", "settled")))


def slowest(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("seconds"), "doc_id").limit(k)


def spec_cases(docs: DataFrame) -> DataFrame:
    """(doc_id, number, section, classes, source, html) of the numbered examples in specifications; arrows stand for tabs.

    An example runs from a fence with the word ``example`` to the next bare fence; a line with a full stop parts source and HTML.
    """
    bare = F.regexp_replace("text", r"\s+$", "")
    order = W.partitionBy("doc_id").orderBy("line")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = lines_of(docs).withColumn("t", bare)
    opens, closes = F.col("t").rlike(f"^{FENCE}\\s*example"), F.col("t") == FENCE
    # Fences alternate; a fence that is open stays so until a bare one.
    mark = F.when(opens, 1).when(closes, -1)
    rows = rows.withColumn("_state", F.last(mark, True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    inside = F.coalesce(F.col("_state"), F.lit(-1)) == 1
    rows = rows.withColumns({"inside": inside & ~closes, "number": F.count_if(opens & ~inside).over(upto)})
    head = F.regexp_extract("t", r"^##? (.*?)(?: \{#.*)?$", 1)
    rows = rows.withColumn("section", F.last(F.when(~F.col("inside") & (head != ""), head), True).over(upto))
    rows = rows.withColumn("classes", F.last(F.when(opens & ~inside, F.trim(F.regexp_extract("t", r"example\s*(.*)$", 1))), True).over(upto)).where("inside")
    dots = F.count_if(F.col("t") == ".").over(W.partitionBy("doc_id", "number").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("dots", dots).where(~((F.col("t") == ".") & (F.col("dots") == 1)))
    side = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("line", "text")))), lambda x: F.concat(F.replace(x["text"], F.lit("→"), F.lit("\t")), F.lit("\n"))), "")
    return rows.groupBy("doc_id", "number", "section", "classes").agg(side(F.col("dots") == 0).alias("source"), side(F.col("dots") > 0).alias("html"))


def mismatch_class(left: Column, right: Column, source: Column, classes: Column, section: Column) -> Column:
    """Why two renderings differ; the first reason that holds."""
    quotes = lambda h: F.replace(h, F.lit("&quot;"), F.lit('"'))
    links = lambda h: sum((T.occurrences(h, f'href="{p}') for p in ("http://", "https://", "ftp://", "mailto:")), F.lit(0))
    either = lambda needle: left.contains(needle) | right.contains(needle)
    return (
        F.when(quotes(left) == quotes(right), "quote-escaping").when(either("<table"), "table-rendering")
        .when((F.array_contains(classes, "autolink") | source.rlike(r"https?://|ftp://|www\.")) & (links(left) != links(right)), "gfm-autolink")
        .when(F.array_contains(classes, "tagfilter"), "gfm-tagfilter").when(either('type="checkbox"'), "tasklist-rendering").when(section.contains("Emphasis"), "emphasis-resolution")
        .when(left.contains("<") & right.contains("<") & source.contains("<"), "html-block-rendering").otherwise("other")
    )


_KINDS = {"p": "paragraph", "ul": "list", "ol": "list", "li": "item", "blockquote": "quote", "pre": "code", "table": "table"} | {f"h{k}": "heading" for k in range(1, 7)}


def envelopes(html: DataFrame, docs: DataFrame) -> DataFrame:
    """``html(doc_id, html)`` with position attributes -> (doc_id, kind, s, e): what each element covers, in bytes of the document."""
    pattern = r'<([A-Za-z][A-Za-z0-9]*)(?:\s+[^>]*)?\sdata-sourcepos="(\d+):(\d+)-(\d+):(\d+)"'
    hit = F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    rows = html.select("doc_id", hit.alias("m")).select("doc_id", *(F.regexp_extract("m", pattern, k).alias(n) for k, n in enumerate(("tag", "sl", "sc", "el", "ec"), 1)))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.lower("tag"))
    rows = rows.select("doc_id", kind.alias("kind"), *(F.col(c).cast("int").alias(c) for c in ("sl", "sc", "el", "ec"))).where("kind is not null")
    lines = at_home(lines_of(docs))
    at = lambda line, col: lines.select("doc_id", F.col("line").alias(line), F.col("s").alias(f"_{line}"), F.col("text").alias(f"_t{line}"))
    rows = rows.join(at("sl", "sc"), ["doc_id", "sl"]).join(at("el", "ec"), ["doc_id", "el"])
    byte = lambda line, n: F.col(f"_{line}") + F.octet_length(F.substring(F.col(f"_t{line}"), F.lit(1), n))
    return rows.select("doc_id", "kind", byte("sl", F.col("sc") - 1).alias("s"), byte("el", F.col("ec")).alias("e"))
