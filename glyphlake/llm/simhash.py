"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Equal fingerprints are merged first, so a group of any number of copies is one row from there on. Two fingerprints within
two bits differ by at most one bit in one of their two 32-bit halves. Each fingerprint is therefore stored in a table
under both halves, and asks that table for every value in the Hamming ball of radius one around both halves (33 each);
matches are verified on all 64 bits.

Table keys under which very many fingerprints lie are not joined pair by pair: there the other half, which must also be
within two bits, is split in two again, which bounds a cell to 2**16 fingerprints of one key, and each cell returns only
links that span its groups.

Defined results: null or empty texts and texts without words have fingerprint zero and link like any other; repeated
rows share a group; rows with a null id keep a null id and belong to the group of their fingerprint; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import Workspace, map_texts
from glyphlake.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats counted; unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        parts = [words[k : len(words) - width + 1 + k] for k in range(width)]
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*parts, strict=True))]
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the columns ``keep``: fp is the fingerprint as a signed long."""

    def run(text: str | None) -> tuple:
        bits = fingerprint(text, width)
        return (bits - (1 << 64) if bits >> 63 else bits,)

    return map_texts(docs, text_col, {c: c for c in dict.fromkeys((id_col, *keep))}, "fp long", run).withColumn(id_col, F.col(id_col).cast("long"))


def _spanning(fps: np.ndarray, asks: np.ndarray, bits: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (ask, fp) that connect all that the links within ``bits`` between ``asks`` and ``fps`` connect.

    Each asker gets one link to each group of ``fps`` near it, and those groups then are one: links grow with the rows, not
    with their pairs. Distances are made block by block, so memory does not grow with the cell either.
    """
    label = np.arange(len(fps))
    left, right = [], []
    for k in range(0, len(asks), block):
        part = asks[k : k + block]
        for j in range(0, len(fps), block):
            close = np.bitwise_count((part[:, None] ^ fps[None, j : j + block]).view(np.uint64)) <= bits
            for i in np.flatnonzero(close.any(axis=1)):
                near = np.flatnonzero(close[i]) + j
                groups, first = np.unique(label[near], return_index=True)
                left += [int(part[i])] * len(groups)
                right += fps[near[first]].tolist()
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def near_links(distinct: DataFrame, ws: Workspace, bits: int = 2, hot: int = 64) -> DataFrame:
    """``distinct(fp)`` -> ``(x, y)``: links within ``bits`` (at most 3) bits that connect exactly what all such links connect.

    Keys with up to ``hot`` table entries are joined pair by pair; the others are handled cell by cell, so ``hot`` sets
    the way, not the result.
    """
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    table = distinct.select("fp", F.posexplode(halves).alias("side", "half")).select("fp", (F.col("side") * F.lit(1 << 32) + F.col("half")).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k) for k in range(32)])
    asks = distinct.select("fp", F.posexplode(halves).alias("side", "half")).select(
        "fp", F.col("side"), F.col("half"), F.explode(flips).alias("flip")
    ).select(F.col("fp").alias("ask"), (F.col("side") * F.lit(1 << 32) + F.col("half").bitwiseXOR(F.col("flip"))).alias("key"))
    crowd = ws.save(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "crowded")

    # Never broadcast the askers: there are 66 for each row of the table they are estimated by.
    cold = table.join(crowd, "key", "left_anti").join(asks.hint("merge"), "key").where("ask < fp and bit_count(ask ^ fp) <= %d" % bits)
    cold = cold.select(F.col("ask").alias("x"), F.col("fp").alias("y"))
    if crowd.isEmpty():
        return cold

    # Crowded keys: the half that the key does not hold, split again into two quarters, radius one for the askers.
    other = F.when(F.col("key") >= F.lit(1 << 32), F.shiftrightunsigned("v", 32)).otherwise(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarters = F.array(F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF)))
    small = F.array(F.lit(0).cast("long"), *[F.lit(1 << k) for k in range(16)])

    def cells(rows: DataFrame, asking: bool) -> DataFrame:
        rows = rows.join(crowd, "key", "left_semi").select("key", "v", F.posexplode(quarters).alias("q", "part"))
        if asking:
            rows = rows.select("key", "v", "q", F.col("part"), F.explode(small).alias("flip")).withColumn("part", F.col("part").bitwiseXOR(F.col("flip")))
        return rows.select("key", (F.col("q") * F.lit(1 << 16) + F.col("part")).alias("cell"), "v", F.lit(asking).alias("asking"))

    stored = cells(table.withColumnRenamed("fp", "v"), False)
    asked = cells(asks.withColumnRenamed("ask", "v"), True).join(stored.select("key", "cell").distinct(), ["key", "cell"], "left_semi")
    both = stored.unionByName(asked)

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        asking = cell["asking"].to_numpy(dtype=bool)
        values = cell["v"].to_numpy()
        x, y = _spanning(np.unique(values[~asking]), np.unique(values[asking]), bits)
        return pd.DataFrame({"x": x, "y": y})

    return cold.unionByName(both.groupBy("key", "cell").applyInPandas(link, "x long, y long").where("x <> y"))


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, fingerprint, component_id, group) and ``keep``.

    component_id is the least id whose fingerprint is reachable by links, group the least of those fingerprints.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    prints = ws.save(fingerprints(docs, width, id_col, text_col, keep), "fingerprints")
    distinct = ws.save(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    groups = connected_components(near_links(distinct.select("fp"), ws, bits).select(F.col("x").alias("a"), F.col("y").alias("b")), ws)
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = ws.save(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id", F.col("component").alias("group"))
    return prints.join(of_fp, F.col("fp") == F.col("_fp")).select(
        id_col, *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group"
    )
