"""Contiguous, byte-balanced shards from global prefix sums. DataFrame functions only.

Rows are laid out in the order (id, text checksum, size), nulls first. The id range is cut at approximate quantiles into
partitions; each partition's byte and row totals are prefix-summed (a table as small as the number of partitions), the
running sum inside a partition is added, and the resulting global byte position is cut at equal targets.

An id that repeats so often that it spans several quantiles (or a null id) is split further by a hash of its text, so no
window holds more than about one partition's share of rows unless rows are wholly identical in id and text.

Defined results: a null text counts no bytes (size 1, checksum 0); repeated rows each get their own slot; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _bucket(col: Column, bounds: list) -> Column:
    """Number of bounds that are <= col, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int = 256) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (position inside the shard, from 0).

    ``partitions`` is the number of ranges whose totals are prefix-summed; raise it with the data.
    """
    key = F.col(id_col)
    if not partitions:
        partitions = 256
    marks = [(i + 1) / partitions for i in range(partitions - 1)]
    seen = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, marks)), 20 * partitions).alias("q"), F.count(F.lit(1)).alias("n"), F.count(key).alias("k")).first()
    quantiles = seen["q"] or []
    bounds = sorted(set(quantiles))
    hot = {v: quantiles.count(v) for v in bounds if quantiles.count(v) > 1}
    parted = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_spread"),
        F.when(key.isNull(), F.lit(-1)).otherwise(_bucket(key, bounds)).cast("int").alias("_part"),
    )
    sub = F.lit(0)
    if hot:  # a hot id is the least of its partition; the others there come after its parts
        numbers = [bounds.index(v) + 1 for v in hot]
        parts = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*map(F.lit, hot.values())))[F.col("_part")]
        least = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*map(F.lit, hot)))[F.col("_part")]
        sub = F.when(parts.isNull(), sub).when(key == least, F.pmod("_spread", parts + 1).cast("int")).otherwise(parts + 1)
    if seen["n"] > seen["k"]:
        share = max(1, round(partitions * (seen["n"] - seen["k"]) / seen["n"]))
        sub = F.when(key.isNull(), F.pmod("_spread", F.lit(share)).cast("int")).otherwise(sub)
    rows = parted.select(id_col, "size", "text_crc32", "_part", sub.alias("_sub"))
    before = W.orderBy("_part", "_sub").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("_part", "_sub").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = (
        rows.groupBy("_part", "_sub")
        .agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col("_part").alias("_p"),
            F.col("_sub").alias("_s"),
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_bytes_all"),
        )
    )
    inside = W.partitionBy("_part", "_sub").orderBy(F.col(id_col), "text_crc32", "size")
    placed = (
        rows.withColumn("_run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(totals), (F.col("_part") == F.col("_p")) & (F.col("_sub") == F.col("_s")))  # at most 2 * partitions rows
        .withColumn("_twice", (F.col("_bytes_before") + F.col("_run")) * 2 - F.col("size"))
        .select(
            id_col,
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.expr(f"(_twice * {shards}) div (2 * _bytes_all)")).cast("int").alias("shard"),
            (F.col("_rows_before") + F.col("_row") - 1).alias("_global"),
        )
    )
    starts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_global").alias("_start"))  # at most `shards` rows
    return placed.join(F.broadcast(starts), F.col("shard") == F.col("_shard")).select(
        id_col, "size", "text_crc32", "shard", (F.col("_global") - F.col("_start")).cast("long").alias("slot")
    )
