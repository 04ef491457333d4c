"""Joins and windows over positions in documents. The document is always an equi-key; what follows is a residual condition or
a window over one document's rows, which a document's size bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def _tests() -> dict[str, Column]:
    s, e, rs, re = (F.col(c) for c in ("s", "e", "_s", "_e"))
    return {"overlap": (s < re) & (rs < e), "inside": (rs <= s) & (e <= re), "start": (rs <= s) & (s < re)}


def _other(ranges: DataFrame, *more: str) -> DataFrame:
    return ranges.select(F.col("doc_id").alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"), *(F.col(c).alias(f"_{c}") for c in more))


def outside(rows: DataFrame, ranges: DataFrame, how: str = "overlap", same: tuple[str, ...] = ()) -> DataFrame:
    """Interval anti join: drop rows that overlap, lie in, or start in one of the ranges; with ``same``, of equal columns."""
    test = (F.col("doc_id") == F.col("_d")) & _tests()[how]
    for c in same:
        test = test & (F.col(c) == F.col(f"_{c}"))
    return rows.join(_other(ranges, *same), test, "left_anti")


def within(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Interval semi join: rows that one of the owners contains."""
    return rows.join(_other(owners), (F.col("doc_id") == F.col("_d")) & _tests()["inside"], "left_semi")


def as_of(points: DataFrame, marks: DataFrame, value: str, at: str = "s", forward: bool = False) -> DataFrame:
    """Adds the ``value`` of the last mark at or before ``at`` (``forward``: the first at or after it); null if there is none.

    Both sides go through one window a document: no range join, whatever the number of marks. The window always runs from its
    start to the row, backwards for ``forward``: one that runs to its end is computed anew for every row.
    """
    mark = marks.select("doc_id", F.col("s").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_mark"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    point = points.select("doc_id", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(f"struct<v:{marks.schema[value].dataType.simpleString()}>").alias("_mark"), F.struct(*points.columns).alias("_row"))
    order = W.partitionBy("doc_id").orderBy(F.desc("_at") if forward else F.asc("_at"), "_side")
    found = F.last("_mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = mark.unionByName(point).withColumn("_found", found).where("_row is not null")
    return rows.select("_row.*", F.col("_found.v").alias(value))


def snapped(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Ranges widened to the marks around them: (doc_id, s, e, lo, hi)."""
    low = as_of(rows, marks.withColumn("lo", F.col("s")), "lo")
    return as_of(low, marks.withColumn("hi", F.col("s")), "hi", at="e", forward=True)


def neighbours(rows: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Every row with the next of its document: the gap to it, and whether they overlap. ``ties`` order equal ranges."""
    order = W.partitionBy("doc_id").orderBy("s", "e", *ties)
    rows = rows.withColumn("next", F.lead("s").over(order))
    return rows.withColumns({"gap": F.col("next") - F.col("e"), "overlaps": F.coalesce(F.col("next") < F.col("e"), F.lit(False))})


def require_disjoint(edits: DataFrame) -> DataFrame:
    """The edits in order; a document whose edits overlap fails the job (unlike fixes, which skip them)."""
    rows = neighbours(edits)
    fail = F.raise_error(F.concat(F.lit("edits overlap in document "), F.col("doc_id").cast("string"))).cast("boolean")
    return rows.where(F.when(F.col("overlaps"), fail).otherwise(F.lit(True))).drop("next", "gap", "overlaps")


def drop_overlapping_families(edits: DataFrame) -> DataFrame:
    """Edits of the families, in each document, of which no two overlap."""
    order = W.partitionBy("doc_id", "family").orderBy("s", "e")
    rows = edits.withColumn("_clash", F.coalesce(F.lead("s").over(order) < F.col("e"), F.lit(False)))
    return rows.withColumn("_bad", F.bool_or("_clash").over(W.partitionBy("doc_id", "family"))).where(~F.col("_bad")).drop("_clash", "_bad")


_LEVELS = 31  # halvings of the offsets that an int holds


def deepest(points: DataFrame, items: DataFrame, value: str) -> DataFrame:
    """For each point the ``value`` of the covering item that starts last.

    An item is cut into aligned cells of 2^k bytes, at most two of a size; a cell keeps the last of its items. A point lies in
    one cell of each size that occurs, so an equi-join finds its items and makes no more rows than points times sizes.
    """
    keys = [f"_p{k}" for k in range(len(points.columns))]

    def bounds(k: int) -> tuple[Column, Column]:
        """The cells of a size within an item: from the first to before the second."""
        return F.shiftright(F.col("_s") + F.lit((1 << k) - 1), k), F.shiftright(F.col("_e"), k)

    cells = []
    for k in range(_LEVELS):
        (a, b), (up, to) = bounds(k), bounds(k + 1)
        for cell, more in ((a, a < b), (b - 1, a < b - 1)):
            larger = (F.shiftright(cell, 1) >= up) & (F.shiftright(cell, 1) < to)
            cells.append(F.when(more & ~larger, F.struct(F.lit(k).alias("k"), cell.alias("cell"))))
    cut = items.select(F.col("doc_id").alias("_d"), F.col("s").cast("long").alias("_s"), F.col("e").cast("long").alias("_e"), F.col(value).alias("_v"))
    cut = cut.select("_d", "_s", "_v", F.explode(F.array_compact(F.array(*cells))).alias("x"))
    last = cut.groupBy("_d", F.col("x.k").alias("_k"), F.col("x.cell").alias("_cell")).agg(F.max(F.struct("_s", "_v")).alias("_best"))
    sizes = F.broadcast(cut.select(F.col("x.k").alias("_size")).distinct())  # at most _LEVELS rows
    at = points.select(*(F.col(c).alias(k) for c, k in zip(points.columns, keys, strict=True)), F.col("doc_id").alias("_doc"), F.col("s").cast("long").alias("_at"))
    at = at.join(sizes).select(*keys, "_doc", "_size", F.expr("shiftright(_at, _size)").alias("_in"))
    rows = at.hint("merge").join(last, (F.col("_doc") == F.col("_d")) & (F.col("_size") == F.col("_k")) & (F.col("_in") == F.col("_cell")))
    rows = rows.groupBy(*keys).agg(F.max("_best").alias("_best"))
    return rows.select(*(F.col(k).alias(c) for c, k in zip(points.columns, keys, strict=True)), F.col("_best._v").alias(value))


def first_wins(rows: DataFrame, keys: list[str], value: str, order: str = "s") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.col(value), F.col(order)).alias(value))


def under_heading(rows: DataFrame) -> DataFrame:
    """Headings (doc_id, s, level, text) with the text of the nearest open one above them, '' at the top.

    A heading closes all that are as deep or deeper; so an open one has no shallower one after it.
    """
    before = W.partitionBy("doc_id").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    at, text = {}, {}
    for k in range(1, 6):
        hit = F.col("level") == k
        at[k], text[k] = F.last(F.when(hit, F.col("s")), True).over(before), F.last(F.when(hit, F.col("text")), True).over(before)
    rows = rows.withColumns({f"_o{k}": c for k, c in at.items()} | {f"_x{k}": c for k, c in text.items()})
    parents = []
    for k in range(5, 0, -1):
        ok = (F.col("level") > k) & F.col(f"_o{k}").isNotNull()
        for j in range(1, k):
            ok = ok & (F.col(f"_o{j}").isNull() | (F.col(f"_o{k}") > F.col(f"_o{j}")))
        parents.append(F.when(ok, F.col(f"_x{k}")))
    return rows.withColumn("parent", F.coalesce(*parents, F.lit(""))).drop(*(f"_o{k}" for k in at), *(f"_x{k}" for k in at))


def depth(events: DataFrame) -> DataFrame:
    """Start (+1) and end (-1) events with the nesting depth after each."""
    order = W.partitionBy("doc_id").orderBy("s", "ord").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum("step").over(order))


def next_close(rows: DataFrame, is_close: Column) -> DataFrame:
    """Adds ``close``: the place of the next closing row of the document, after this one."""
    return rows.withColumn("close", F.min(F.when(is_close, F.col("s"))).over(after("doc_id")))


def after(*keys: str) -> WindowSpec:
    """The rows behind each one, by ``s``. Read backwards, as a window that runs to its end is computed anew for every row."""
    return W.partitionBy(*keys).orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, -1)


def islands(rows: DataFrame, flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows (by ``line``) as (doc_id, first, last)."""
    rows = rows.where(flag).withColumn("_island", F.col("line") - F.row_number().over(W.partitionBy("doc_id").orderBy("line")))
    return rows.groupBy("doc_id", "_island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("_island")
