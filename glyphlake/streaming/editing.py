"""Documents that are being edited, as streams keyed by document.

An edit carries the whole new text and a version. State holds the newest version; older edits that come late are dropped,
closing a document forgets it. A lint pass waits until a document has been quiet for a while (debounce): a session window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphlake.fmt.engine import formatted
from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts
from glyphlake.operators.ranges import snapped
from glyphlake.rules.run import RuleSet, configured, diagnostics
from glyphlake.sources.config import Config, Fmt

ACCEPTED = "uri string, n long, version long, kind string, text string, status string, due string"
STATE = "version long, text string, n long"
LIMIT = 10_000_000


def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, limit: int = LIMIT) -> Iterator[pd.DataFrame]:
    """What takes effect, in order of arrival, numbered by ``n``.

    An open replaces what was known. A change with a version below the current one comes late and is dropped. A save tells
    of the text as it is. Opens and saves are due for a check at once, changes when the document is quiet. A close forgets
    the document. Too large a text is marked, kept out of the state, and not passed on.
    """
    version, text, n = state.get if state.exists else (None, None, 0)
    first, *others = batches
    rows = pd.concat([first, *others]) if others else first
    if len(rows) > 1:  # most documents of a batch have one edit, and pandas is slow on small frames
        rows = rows.sort_values(["arrival", "version", "kind"])
    out = []
    for kind, new, body in zip(rows["kind"], rows["version"], rows["text"], strict=True):
        if kind == "save" and version is None or kind == "change" and version is not None and new < version:
            continue
        n += 1
        if kind == "close":
            version = text = None
            out.append((key[0], n, new, kind, None, "closed", "now"))
        elif kind == "save":
            out.append((key[0], n, version, kind, text, "too-large" if text is None else "open", "now"))
        else:
            version, text = int(new), body if body is not None and len(body.encode()) <= limit else None
            out.append((key[0], n, new, kind, text, "too-large" if text is None else "open", "now" if kind == "open" else "quiet"))
    if version is None:
        state.remove()
    else:
        state.update((version, text, n))
    names = ["uri", "n", "version", "kind", "text", "status", "due"]
    yield pd.DataFrame(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else [], columns=None if out else names)


def accepted(edits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``edits(uri, version, kind, text, arrival)`` as a stream -> those that take effect.

    Texts over the limit are dropped before the shuffle; ``accept`` takes a missing text for one that is too large.
    """
    one = partial(accept, limit=limit)
    edits = edits.withColumn("text", F.when(F.octet_length("text") <= limit, F.col("text")))
    return edits.groupBy("uri").applyInPandasWithState(one, ACCEPTED, STATE, "append", GroupStateTimeout.NoTimeout)


def first_change(changes: Column) -> Column:
    """The text of an edit that lists several whole-text changes: the first counts."""
    return F.get(changes, F.lit(0))


def open_documents(rows: DataFrame) -> DataFrame:
    """(uri, version, text) of the documents that are open after all ``accepted`` rows."""
    last = rows.groupBy("uri").agg(F.max_by(F.struct("version", "text", "status"), F.col("n")).alias("x"))
    return last.where("x.status <> 'closed'").select("uri", "x.version", "x.text")


def current_results(results: DataFrame, documents: DataFrame, revision: int) -> DataFrame:
    """Results of checks that are not stale: the document still has their version, and the configuration their revision."""
    now = documents.select("uri", F.col("version").alias("_now"))
    return results.where(F.col("revision") == revision).join(now, "uri").where("version = _now").drop("_now")


def relint(documents: DataFrame, config: Config, revision: int) -> DataFrame:
    """Every open document checked under a new configuration; the findings carry its revision."""
    docs = documents.where("text is not null").select(F.xxhash64("uri").alias("doc_id"), "uri", "version", "text")
    found = diagnostics(docs, configured(config))
    return found.join(docs.select("doc_id", "uri", "version"), "doc_id").drop("doc_id").withColumn("revision", F.lit(revision))


def negotiated(offers: Column) -> Column:
    """The position encoding of a client that offers an array of them. Edits need utf-8; utf-16 is what all speak."""
    return F.when(F.array_contains(offers, "utf-8"), "utf-8").otherwise("utf-16")


def range_edits(docs: DataFrame, start: Column, end: Column, options: Fmt) -> DataFrame:
    """(doc_id, s, e, text): the top-level blocks around a byte range of each document, formatted.

    The range is widened to the parse's checkpoints (an as-of join on either side) and only that slice is formatted.
    """
    facts = Facts(docs, ["checkpoints"])
    wanted = facts.docs.select("doc_id", start.cast("int").alias("s"), end.cast("int").alias("e"))
    spans = snapped(wanted, facts.table("checkpoints").select("doc_id", "s").distinct())
    cut = spans.join(facts.docs, "doc_id").select("doc_id", "lo", "hi", T.bytes_of(F.col("text"), F.col("lo"), F.col("hi")).alias("text"))
    new = formatted(cut.select("doc_id", "text"), options)
    return cut.select("doc_id", F.col("lo").alias("s"), F.col("hi").alias("e")).join(new.where("changed").select("doc_id", F.col("formatted").alias("text")), "doc_id")


def debounced(edits: DataFrame, quiet: str = "300 milliseconds") -> DataFrame:
    """The newest edit of each burst: edits of a document that follow each other within ``quiet`` are one burst."""
    window = F.session_window("arrival", quiet)
    newest = F.max_by(F.struct("version", "text"), F.col("version")).alias("x")
    rows = edits.groupBy("uri", window.alias("burst")).agg(newest, F.count(F.lit(1)).alias("n_edits"))
    return rows.select("uri", F.col("burst.start").alias("started"), F.col("burst.end").alias("due"), "x.version", "x.text", "n_edits")


def run_to_end(stream: DataFrame, spark_dir: str, mode: str = "append") -> DataFrame:
    """Drain what is there now, exactly once, into a table; returns the table."""
    name = uuid.uuid4().hex
    path, mark = f"{spark_dir}/stream-{name}", f"{spark_dir}/mark-{name}"
    session, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return session.read.schema(schema).parquet(path)


def lint_each(edits: DataFrame, publish: Callable[[DataFrame], None], rules: RuleSet | None = None, checkpoint: str | None = None) -> object:
    """Lint what takes effect in each micro-batch and hand the findings to ``publish``.

    If one batch holds several versions of a document, only the newest is linted: older results would be stale.
    """

    def each(rows: DataFrame, _: int) -> None:
        newest = rows.where("status = 'open'").groupBy("uri").agg(F.max_by(F.struct("version", "text"), F.col("n")).alias("x"))
        docs = newest.select(F.xxhash64("uri").alias("doc_id"), "uri", "x.version", "x.text")
        found = diagnostics(docs, rules, share=False)
        publish(found.join(docs.select("doc_id", "uri", "version"), "doc_id").drop("doc_id"))

    writer = accepted(edits).writeStream.foreachBatch(each).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def covering(found: DataFrame, line: int, col: int) -> DataFrame:
    """Findings at a cursor (hover)."""
    width = F.greatest(F.col("span_end") - F.col("span_start"), F.lit(1))
    return found.where((F.col("line") == line) & (F.col("col") <= col) & (F.lit(col) < F.col("col") + width))


def actions(found: DataFrame, start: int, end: int) -> DataFrame:
    """Safe fixes of findings that a byte range touches (code actions)."""
    return found.where(F.col("safe") & F.col("replacement").isNotNull() & (F.col("span_start") <= end) & (F.col("span_end") >= start))
