"""Exact substring deduplication over long word windows, by recompression.

A word goes if it lies in a window of ``width`` words whose sequence also starts in a document with a smaller id.

1. One pass over the texts recompresses each (see ``recompress``) and gives every window the name of one symbol inside it
   that equal windows share. Neighbouring windows choose the same symbol, so a document has about a twelfth as many
   choices as words. Each choice keeps its windows as a block: first window, count, and 96 bits of hash of the words they cover.
2. Names that occur in one text only are dropped; most do. Blocks that also occur in a smaller document are removed as a
   whole, and need not be looked at again: the smaller document has all their windows.
3. Where a name is shared by blocks that differ, the windows of the first occurrence of each block are hashed one by one
   (96 bits) and the least document of every hash is taken.
4. Texts that lose words are joined with their ranges and cut.

Texts are filtered before the two joins that need them by a bit map of ids of at most ``most_bits`` bits: a bounded
broadcast that only ever lets too many rows through. All counts are by hash aggregation with partial sums and all joins
are plain equi-joins, so neither a passage nor a copy that a third of all documents share meets in one task.

Defined results: null or empty texts have no words and lose none; rows that repeat an id are not smaller than each other
and keep their words; rows with a null id lose nothing and take nothing from others; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.llm.common import Workspace, map_texts
from glyphlake.llm.recompress import WordHashes, anchors, window_hashes

_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_HASHES = WordHashes()
_NOTHING = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def content_of(words: list[bytes]) -> tuple[str, int]:
    """SHA-256 of the words joined by one space, and its first 64 bits as a signed number."""
    digest = hashlib.sha256(b" ".join(words))
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "big", signed=True)


def _pieces(words: list[bytes], width: int, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """A very long text in parts that overlap by width - 1 words, so that each window is in one part."""
    at = 0
    while True:
        yield at, words[at : at + longest]
        if at + longest >= len(words):
            return
        at += longest - width + 1


def _choices(group: list[tuple[int, int, list[bytes]]], width: int, rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, names, two block hashes, first windows, counts) of each part in ``group`` (document, offset, words)."""
    total = sum(len(w) for _, _, w in group) + len(group) + 1
    word, is_word = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=bool)
    starts, bounds, at = [], [], 1
    for _, _, words in group:
        word[at : at + len(words)] = _HASHES.of(words)
        is_word[at : at + len(words)] = True
        n = max(0, len(words) - width + 1)
        starts.append(np.arange(at, at + n))
        bounds.append((at, n))
        at += len(words) + 1
    windows = np.concatenate(starts)
    name, place = anchors(word, is_word, windows, width, rounds)
    hashed = [window_hashes(word, width, base) for base in _BASES]
    done = 0
    for (doc, offset, _), (slot, n) in zip(group, bounds, strict=True):
        if n:
            own = slice(done, done + n)
            p, q = place[own], name[own]
            first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            count = np.diff(np.append(first, n))
            # All windows of a block hold its symbol, so its first and last window overlap and cover all its words.
            block, check = (h[slot + first] * np.uint64(0x9E3779B97F4A7C15) + h[slot + first + count - 1] for h in hashed)
            yield doc, q[first], block, check >> np.uint64(33), first + offset, count
            done += n


def _scan(docs: DataFrame, width: int, rounds: int, id_col: str, text_col: str, most_words: int = 200_000, longest: int = 400_000) -> DataFrame:
    names = ["doc_id", "sha", "rk", "n_words", "names", "blocks", "checks", "starts", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads, found, group, held = batch.column(0), [], [], [], 0

            def flush() -> None:
                for doc, *arrays in _choices(group, width, rounds):
                    found[doc].append(arrays)
                group.clear()

            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                heads.append((*content_of(words), len(words)))
                found.append([])
                if len(words) >= width and ids[row].is_valid:
                    for offset, part in _pieces(words, width, longest):
                        group.append((row, offset, part))
                        held += len(part)
                        if held >= most_words:
                            flush()
                            held = 0
            if group:
                flush()
            columns = []
            for k in range(5):
                sizes = [sum(len(part[k]) for part in parts) for parts in found]
                flat = np.concatenate([np.zeros(0, np.uint64 if k < 3 else np.int64), *(part[k] for parts in found for part in parts)])
                offsets = np.cumsum([0, *sizes]).astype(np.int32)
                flat = flat.view(np.int64) if k < 2 else flat.astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            sha, rk, n = zip(*heads, strict=True) if heads else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sha, pa.string()), pa.array(rk, pa.int64()), pa.array(n, pa.int64()), *columns], names=names)

    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small.mapInArrow(run, "doc_id long, sha string, rk long, n_words long, names array<long>, blocks array<long>, checks array<int>, starts array<int>, counts array<int>")


class IdFilter:
    """Bit map of hashed ids: whoever is in the set passes, few others do. Its size is bounded by ``most_bits``.

    The map is a table of at most ``most_bits / 32768`` rows of 4 KB, which is broadcast; bits are tested in the JVM.
    """

    def __init__(self, ids: DataFrame, column: str, most_bits: int, ws: Workspace):
        n = ids.count()
        self.bits = min(most_bits, max(1 << 16, 1 << (8 * n).bit_length()))
        at = ids.select(self.position(F.col(column)).alias("at"))
        maps = at.groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_map"))
        self.maps = ws.save(maps, "bits")

    def position(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits)) + 1

    def texts(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc_id, text) of the rows that may be in the set."""
        id_ = F.col(id_col).cast("long")
        rows = docs.where(F.col(id_col).isNotNull()).select(id_.alias("doc_id"), F.col(text_col).alias("text"), self.position(id_).alias("_at"))
        byte = "cast(conv(hex(substring(_map, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10) as int)"
        is_set = F.expr(f"(shiftright({byte}, cast(bitmap_bit_position(_at) % 8 as int)) & 1) = 1")
        rows = rows.withColumn("_b", F.bitmap_bucket_number("_at")).join(F.broadcast(self.maps), F.col("_b") == F.col("_bucket"))
        return rows.where(is_set).select("doc_id", "text")


def _union(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    yield from zip(s[cut].tolist(), e[np.append(cut[1:], len(e)) - 1].tolist(), strict=True)


def remove_repeats(docs: DataFrame, width: int = 50, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 26) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    ws = Workspace(docs.sparkSession, "substrings")
    scanned = ws.save(_scan(docs, width, rounds, id_col, text_col), "scanned")

    # Exact copies of a smaller document lose all their words.
    long_enough = scanned.where((F.col("n_words") >= width) & F.col("doc_id").isNotNull()).select("doc_id", "sha")
    # A content that over a thousandth of all rows share is one of less than a thousand: those meet their rows by a bounded
    # broadcast, so that no content's rows are shuffled into one task.
    total = long_enough.count()
    sums = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("copies")]
    copied = ws.save(long_enough.groupBy("sha").agg(*sums).where("least < most").withColumn("hot", F.col("copies") * 1000 > total).drop("most", "copies"), "copied")
    hot, cold = (copied.where(F.col("hot") == h).select("sha", "least") for h in (True, False))
    by_hot = long_enough.join(F.broadcast(hot), "sha")
    by_cold = long_enough.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold, "sha")
    copies = ws.save(by_hot.unionByName(by_cold).where("doc_id > least").select("doc_id", "sha").distinct(), "copies")

    zipped = F.explode(F.arrays_zip("names", "blocks", "checks", "starts", "counts"))
    entries = scanned.where(F.size("names") > 0).select("doc_id", "rk", zipped.alias("x"))
    entries = entries.select("doc_id", "rk", *[F.col(f"x.{f}").alias(n) for f, n in (("names", "name"), ("blocks", "block"), ("checks", "check"), ("starts", "start"), ("counts", "n"))])
    ends = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("rk").alias("one"), F.max("rk").alias("other")]
    # Written before it is joined: both sides of the join then are exchanges, whose hot keys can be split.
    names = ws.save(entries.groupBy("name").agg(*ends).where("least < most and one <> other").select("name"), "names")
    shared = ws.save(entries.join(names, "name", "left_semi"), "shared")
    blocks = ws.save(shared.groupBy("name", "block", "check", "n").agg(F.min("doc_id").alias("least")), "blocks")
    several = ws.save(blocks.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name"), "several")
    known = shared.join(blocks, ["name", "block", "check", "n"])
    whole = known.where("doc_id > least").select("doc_id", "rk", "start", "n")
    first = known.where("doc_id = least").join(several, "name", "left_semi")
    todo = ws.save(first.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "todo")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            for doc, text, rk, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if content_of(words)[1] != rk:  # another row with this id
                    continue
                h = _HASHES.of(words)
                at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges]))
                a = window_hashes(h, width, _BASES[0])[at].view(np.int64)
                b = (window_hashes(h, width, _BASES[1])[at] >> np.uint64(33)).astype(np.int32)
                same = [np.full(len(at), doc), np.full(len(at), rk)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([a, b, *same, at], kinds, strict=True)], names=["a", "b", "doc_id", "rk", "start"])

    texts = IdFilter(todo, "doc_id", most_bits, ws).texts(docs, id_col, text_col)
    windows = ws.save(texts.join(todo, "doc_id").mapInArrow(hashes, "a long, b int, doc_id long, rk long, start int"), "windows")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = ws.save(least, "least")
    single = windows.join(least, ["a", "b"]).where("doc_id > least").select("doc_id", "rk", "start", F.lit(1).alias("n"))
    ranges = whole.unionByName(single).groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    is_copy = copies.select("doc_id", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long").alias("rk"))
    ranges = ws.save(ranges.join(is_copy, ["doc_id", "rk"], "left_anti"), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, rk, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if content_of(words)[1] != rk:
                    continue
                s = np.array([r["start"] for r in parts])
                at, kept = 0, []
                for a, b in _union(s, s + np.array([r["n"] for r in parts]) + width - 1):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc, rk, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["_id", "_rk", "_removed", "_kept"])

    texts = IdFilter(ranges, "doc_id", most_bits, ws).texts(docs, id_col, text_col)
    partly = texts.join(ranges, "doc_id").mapInArrow(cut, "_id long, _rk long, _removed long, _kept string").dropDuplicates(["_id", "_rk"])
    wholly = copies.select(F.col("doc_id").alias("_cid"), F.col("sha").alias("_csha"))
    out = scanned.select("doc_id", "sha", "rk", "n_words").join(partly, (F.col("doc_id") == F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")
    out = out.join(wholly, (F.col("doc_id") == F.col("_cid")) & (F.col("sha") == F.col("_csha")), "left")
    copy = F.col("_cid").isNotNull()
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("_kept", "sha")).alias("kept_sha256"),
    )
