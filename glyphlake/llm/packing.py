"""Best-fit packing planned over a histogram of lengths instead of over documents.

1. Executors tokenize every document once and keep, per piece, its length and a checksum of its ids.
2. Piece lengths are counted. The histogram has at most ``window`` rows whatever the corpus, so the driver plans on it:
   lengths go from longest to shortest, each batch of equal pieces into the open sequences with the least room that fits.
   Whole groups of like sequences are filled at once, so the plan's size depends on the number of lengths only.
3. Pieces take planned places by joining on their rank within their length. Ranks come from two-level counts (length and
   a hash of the id), so a length that a third of all pieces share is not ranked in one task.

Defined results: a null text has no ids but the closing one; documents longer than the window are cut into full pieces,
the first one taking the remainder; repeated rows are packed each on its own; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from glyphlake.llm.common import Workspace

SPECIAL = "<|endoftext|>"
_PIECE = ("piece", "start", "length", "ids_crc32")
_ENCODERS: dict[str, tuple] = {}


def _encoder(name: str):
    """The vocabulary as byte ranks (fast), and the same vocabulary with its special token for texts that spell it."""
    if name not in _ENCODERS:
        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[name] = (fast, lambda: Tokenizer.from_file(files.path(f"{name}.json")))
    return _ENCODERS[name]


def token_ids(text: str | None, name: str) -> list[int]:
    """Ids as the JSON tokenizer of that name gives them without adding special tokens."""
    if not text:
        return []
    fast, exact = _encoder(name)
    if SPECIAL in text:
        return exact().encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids; only the first may be short."""
    if n <= window:
        return [(0, n)]
    first = n % window or window
    return [(0, first), *((s, window) for s in range(first, n, window))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*token_ids(text, tokenizer), end_id], dtype="<u4")
                out += [(row, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), window))]
            rows, *rest = zip(*out, strict=True) if out else [()] * 5
            made = [pa.array(c, type=t) for c, t in zip(rest, (pa.int32(), *[pa.int64()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int32())), *made], names=[id_col, *_PIECE])

    small = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text_"))
    return small.mapInArrow(run, f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], window: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over counts.

    Returns, per length, runs (first rank, count, first sequence, offset), and the number of sequences. Open sequences are
    kept by room left, as intervals of sequence numbers with the same room; filling one splits at most one interval.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    total = 0
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = window // length
                opened = -(-left // each)
                rooms.setdefault(window, []).append((total, opened))
                total += opened
                continue
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            fits = room // length
            full = min(n, left // fits)
            if full:  # these sequences take as many pieces of this length as fit
                for k in range(fits):
                    runs.append((rank, full, first, window - room + k * length))
                    rank += full
                left -= full * fits
                if room - fits * length:
                    rooms.setdefault(room - fits * length, []).append((first, full))
            rest = (first + full, n - full)
            if left and rest[1] and left < fits:  # the last few pieces share one sequence
                for k in range(left):
                    runs.append((rank, 1, rest[0], window - room + k * length))
                    rank += 1
                if room - left * length:
                    rooms.setdefault(room - left * length, []).append((rest[0], 1))
                left, rest = 0, (rest[0] + 1, rest[1] - 1)
            if rest[1]:
                rooms.setdefault(room, []).append(rest)
        plan[length] = runs
    return plan, total


def pack_best_fit(
    docs: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", spread: int = 128
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``spread`` is the number of hash parts in which the pieces of one length are ranked.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    pieces = ws.save(tokenized_pieces(docs, tokenizer, end_id, window, id_col, text_col), "pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    plan, _ = plan_best_fit({r["length"]: r["n"] for r in counted}, window)
    arrays = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for n, runs in plan.items()}
    shared = spark.sparkContext.broadcast(arrays)  # runs depend on the number of lengths, not of pieces

    parts = pieces.withColumn("_part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(spread)).cast("int"))
    counts = parts.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most window * spread rows
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("_length"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")
    ranked = parts.withColumn("_row", F.row_number().over(inside)).join(offsets, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_row") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, _, base, off = shared.value[int(n)]
                run = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at] = base[run] + ranks[at] - first[run]
                offset[at] = off[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, *_PIECE, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
