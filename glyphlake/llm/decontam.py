"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Item texts and documents are normalised alike (A-Z lower-cased, runs of word characters are words). Every window of an item
is one pattern of the automaton, which reads numbered words. A document is read once; all overlapping occurrences are found, and
each is mapped back to its words and to its characters in the original text.

The benchmark is the stated query set. Up to ``block_chars`` characters of it are one automaton (24 nodes for each word of
the benchmark at most, so some 400 MB); documents then pass in one stage without a shuffle. A longer benchmark is read in
blocks of that size, one after the other, each with a pass of its own over the documents, so that neither the driver nor an
executor holds more than one.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window; items that share
a window all count; repeated rows are each reported; an empty benchmark leaves every document clean; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat
import ahocorasick
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.llm.common import Workspace, map_texts

#: UTF-8 bytes: A-Z become lower case, other ASCII bytes that are not 0-9 or a-z become spaces, the rest stays.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BUILT: dict[tuple, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]


_BASE = 128  # branches of a node at most; three digits number more words than a block can hold


class WordAutomaton:
    """An Aho-Corasick automaton over numbered words.

    A word of the patterns is written as three characters, its number's digits, each place with an alphabet of its own, so
    that no match begins inside a word; all other words are three NULs.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple]):
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for window, items in patterns.items():
            for w in window:
                if w not in self.codes:
                    k = len(self.codes)
                    self.codes[w] = "".join(chr(1 + place * _BASE + k // _BASE**place % _BASE) for place in (0, 1, 2))
            self.automaton.add_word("".join(map(self.codes.__getitem__, window)), (len(window), items))
        if patterns:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Starts and ends (exclusive) of the hit word ranges, and the ids of the items that occur."""
        if not words or not self.codes:
            return [], [], set()
        found = list(self.automaton.iter("".join(map(self.codes.get, words, repeat("\0\0\0")))))
        ends = [e // 3 + 1 for e, _ in found]
        return [e - n for e, (_, (n, _)) in zip(ends, found, strict=True)], ends, {i for _, (_, items) in found for i in items}


def _automaton(key: tuple, patterns: dict[tuple[bytes, ...], tuple]) -> WordAutomaton:
    """Built once in each Python worker, which keeps one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WordAutomaton(patterns)
    return _BUILT[key]


def covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as ranges of characters of the original text."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    at = [m.span() for m in _WORD.finditer(lower)] if ranges else []
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


def block_count(items: DataFrame, block_chars: int, text_col: str) -> int:
    size = items.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    return max(1, -(-size // block_chars))


def item_block(items: DataFrame, k: int, n: int, width: int, id_col: str, text_col: str) -> dict[tuple[bytes, ...], tuple]:
    """The windows of the ``k``-th of ``n`` parts of the benchmark, each with the ids of its items."""
    rows = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k).select(id_col, text_col).collect()
    patterns: dict[tuple[bytes, ...], set] = {}
    for item, text in rows:
        for window in windows_of(words_of(text), width):
            patterns.setdefault(window, set()).add(item)
    return {w: tuple(v) for w, v in patterns.items()}


_HITS = "starts array<int>, ends array<int>, ids array<string>"


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = 1_500_000, text_as: str | None = None,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items, contaminated, char_spans; and the columns in ``keep``."""
    spark = docs.sparkSession
    n, names = block_count(items, block_chars, item_text), list(dict.fromkeys([id_col, *(keep or [])]))

    def part(k: int) -> tuple[tuple, Broadcast]:
        block = item_block(items, k, n, width, item_id, item_text)
        return (zlib.crc32(repr(sorted(block)).encode()), len(block), k), spark.sparkContext.broadcast(block)

    def finish(text: str | None, words: list[bytes], starts: list[int], ends: list[int], ids: set[str]) -> tuple:
        ranges = covered(starts, ends)
        spans = [x for span in char_spans(text, ranges) for x in span] if ranges else []
        return len(words), sum(e - s for s, e in ranges), len(ids), sorted(ids), spans, len(ids) >= least_items

    def last(text: str | None, starts: list[int], ends: list[int], ids: list[str]) -> tuple:
        words = words_of(text)
        s, e, i = _automaton(key, block.value).hits(words)
        return finish(text, words, [*starts, *s], [*ends, *e], {*ids, *map(str, i)})

    def more(text: str | None, starts: list[int], ends: list[int], ids: list[str]) -> tuple:
        s, e, i = _automaton(key, block.value).hits(words_of(text))
        return [*starts, *s], [*ends, *e], sorted({*ids, *map(str, i)})

    fields = "n_words long, n_hit long, n_items long, items array<string>, char_spans array<int>, contaminated boolean"
    same = {c: c for c in names}
    if n == 1:
        key, block = part(0)
        return map_texts(docs, text_col, same, fields, lambda text: last(text, [], [], []), text_as)
    # A benchmark of several blocks: one pass and one written table for each, so that one block is held at a time.
    ws = Workspace(spark, "decontamination")
    found = docs.select(*names, F.col(text_col).alias("_text"), *(F.expr(f"cast(array() as {t})").alias(c) for c, t in (x.split(" ") for x in _HITS.split(", "))))
    for k in range(n - 1):
        key, block = part(k)
        step = ws.save(map_texts(found, "_text", same, _HITS, more, "_text", ("starts", "ends", "ids")), f"block{k}")
        block.destroy()
        ws.drop(found)
        found = step
    key, block = part(n - 1)
    out = map_texts(found, "_text", same, fields, last, text_as or "_text", ("starts", "ends", "ids"))
    return out if text_as else out.drop("_text")


def items_digest(items: Column | str) -> Column:
    """Lower-case hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)
