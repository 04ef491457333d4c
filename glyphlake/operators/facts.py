"""Fact tables of a corpus: one parse of each document in Python, everything after it in the JVM."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glyphlake.operators.batches import slices
from glyphlake.parse.facts import Options, blank_ends, byte_offsets, canonical as plain, parse
from glyphlake.sources.scratch import written

_FIELDS = ["doc_id", "fact", "ord", "s", "e", "text", "kind", "label", "n"]
FACT_SCHEMA = "doc_id long, fact string, ord int, s int, e int, text string, kind string, label string, n int"
ALL_FACTS = (
    "nodes headings heading_attrs code_blocks html_blocks suppressions thematic_breaks list_groups list_items link_defs tables table_cells block_gaps prose "
    "inline_codes inline_html autolinks link_like links link_dests emphasis math_regions math_errors frontmatter parse_errors "
    "tree checkpoints item_widths definition_sites transparent wrappable"
).split()


def canonical(text: str = "text") -> Column:
    """CRLF and CR to LF, NUL to the replacement character."""
    t = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    return F.replace(F.replace(t, F.lit("\r"), F.lit("\n")), F.lit("\0"), F.lit("\ufffd"))


def parse_facts(docs: DataFrame, wanted: list[str], options: Options | None = None, marks: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per fact of the kinds in ``wanted``; also ``blank_ends``, which need no parse.

    Only what is wanted leaves Python, of ``prose`` only runs that hold one of the ``marks`` if these are given. A document
    that cannot be parsed gives a ``parse_errors`` row, never a failed task.
    """
    keep, opts = set(wanted), options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gc.disable()  # a parse hangs in no cycle, and the collector would walk the rows of the slice again and again
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    facts = parse(text or "", opts, wanted=keep, marks=marks).facts
                except (RecursionError, ValueError, IndexError) as error:
                    facts = {"parse_errors": [{"s": 0, "e": 0, "text": type(error).__name__}]}
                    if "blank_ends" in keep:
                        facts["blank_ends"] = blank_ends(plain(text), byte_offsets(plain(text)))
                for fact in keep & facts.keys():
                    rows += [(doc, fact, k, f["s"], f["e"], f.get("text"), f.get("kind"), f.get("label"), f.get("n")) for k, f in enumerate(facts[fact])]
            columns = zip(*rows, strict=True) if rows else [()] * 9
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=_FIELDS)
            gc.enable()
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FACT_SCHEMA)


class Facts:
    """The facts that a set of rules reads. Parsed once and written if several rules share them."""

    def __init__(self, docs: DataFrame, wanted: list[str], options: Options | None = None, share: bool = False, marks: str | None = None):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical().alias("text"))
        self._all = parse_facts(self.docs, wanted, options, marks)
        if share:
            # By kind, so that a plan that reads one kind skips the pages of all others.
            self._all = written(self._all.sortWithinPartitions("fact"), "facts")

    def table(self, fact: str) -> DataFrame:
        return self._all.where(F.col("fact") == fact).drop("fact")

    @property
    def lines(self) -> DataFrame:
        """(doc_id, line, s, e, text) without any parse: line starts are running byte sums."""
        return lines_of(self.docs)


def lines_of(docs: DataFrame, short: int = 2000) -> DataFrame:
    """(doc_id, line, s, e, text) of every line; a last empty line is none.

    Starts are running byte sums: inside the row for texts of up to ``short`` lines, so those need no shuffle; for longer
    ones, where that would cost the square of their lines, by a window over the text's own lines.
    """
    parts = F.split("text", "\n", -1)
    rows = docs.where(F.col("text") != "").select("doc_id", "text", F.size(parts).alias("n"))
    sizes = F.transform(parts, lambda p: F.octet_length(p) + 1)
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    zipped = F.arrays_zip(parts.alias("t"), F.slice(starts, F.lit(1), F.size(parts)).alias("s"))
    few = rows.where(F.col("n") <= short).select("doc_id", "n", F.posexplode(zipped).alias("k", "x")).select("doc_id", "n", "k", "x.t", "x.s")
    before = W.partitionBy("doc_id", "id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    many = rows.where(F.col("n") > short).select("doc_id", "n", F.xxhash64("text").alias("id"), F.posexplode(parts).alias("k", "t"))
    many = many.select("doc_id", "n", "k", "t", F.coalesce(F.sum(F.octet_length("t") + 1).over(before), F.lit(0)).cast("int").alias("s"))
    out = few.unionByName(many).where((F.col("k") + 1 < F.col("n")) | (F.col("t") != ""))
    return out.select("doc_id", (F.col("k") + 1).alias("line"), "s", (F.col("s") + F.octet_length("t")).alias("e"), F.col("t").alias("text"))


def at_home(texts: DataFrame) -> DataFrame:
    """Rows as long as the corpus, never broadcast in a join: the planner takes computed texts and lists for a few bytes each."""
    return texts.hint("merge")


def located(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds 1-based line and code point column of the byte offset ``s``. An equi-join on the document; no range join."""
    prefix = F.decode(F.substring(F.encode("_text", "UTF-8"), F.lit(1), F.col("s")), "UTF-8")
    joined = rows.join(at_home(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))), F.col("doc_id") == F.col("_doc"))
    before = joined.withColumn("_before", prefix)
    line = F.length("_before") - F.length(F.replace("_before", F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index("_before", "\n", -1)) + 1
    return before.withColumns({"line": line, "col": column}).drop("_doc", "_text", "_before")


def occurrence(*keys: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy("s"))
