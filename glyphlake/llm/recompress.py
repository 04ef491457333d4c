"""Recompression of word sequences in numpy: names for runs and pairs that depend on their content only.

A round first gives every run of one symbol a name, then splits the symbols in two sides by a bit of their names and gives
every adjacent (left, right) pair a name. Names are 64-bit hashes of what they stand for, so equal content has equal names
in every document and on every executor, round by round, with no dictionary to pass around.

Beside its extent a symbol carries its support: the range of words that decided how it came to be. A symbol whose support
lies inside some stretch of words is found, with the same name and place, in every copy of that stretch, whatever stands
around the copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _D
    x = (x ^ (x >> _S)) * _D
    return x ^ (x >> _S)


def _times(k: int, c: np.uint64) -> np.uint64:
    return np.uint64(k * int(c) & (1 << 64) - 1)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 1)
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@dataclass
class Level:
    name: np.ndarray  # symbols
    start: np.ndarray  # extents, half-open, in words
    end: np.ndarray
    low: np.ndarray  # supports, half-open; they do not decrease from symbol to symbol
    high: np.ndarray


def _runs(v: Level, word: np.ndarray) -> Level:
    n = len(v.name)
    same = np.empty(n, dtype=bool)  # as the symbol before
    same[0] = False
    same[1:] = (v.name[1:] == v.name[:-1]) & (v.start[1:] == v.end[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    count = last - first + 1
    name = v.name[first]
    long = count > 1
    name = np.where(long, mix(name * _C + count.astype(np.uint64)), name)
    start, end, low, high = v.start[first], v.end[last], v.low[first].copy(), v.high[last].copy()
    # That a run ends here is known from one word beyond it if that word differs from the run's; else from the whole symbol.
    before, after = start - 1, end
    low = np.minimum(low, before)
    high = np.maximum(high, after + 1)
    twin = np.flatnonzero((word[before] == word[end - 1]) & (first > 0))
    if len(twin):
        low[twin] = np.minimum(low[twin], v.low[first[twin] - 1])
    twin = np.flatnonzero((word[after] == word[start]) & (last < n - 1))
    if len(twin):
        high[twin] = np.maximum(high[twin], v.high[last[twin] + 1])
    return Level(name, start, end, low, high)


def _pairs(v: Level, salt: int) -> Level:
    n = len(v.name)
    left = (mix(v.name + _times(salt, _A)) & np.uint64(1)).astype(bool)
    joined = np.zeros(n, dtype=bool)  # with the symbol after
    joined[:-1] = left[:-1] & ~left[1:] & (v.end[:-1] == v.start[1:])
    taken = np.zeros(n, dtype=bool)
    taken[1:] = joined[:-1]
    # A symbol left alone shows that its neighbour on the open side did not fit.
    low, high = v.low.copy(), v.high.copy()
    alone = ~joined & ~taken
    right_of = np.empty(n, dtype=np.int64)
    right_of[:-1] = np.where(v.end[:-1] == v.start[1:], v.high[1:], v.end[:-1] + 1)
    right_of[-1] = v.end[-1] + 1
    left_of = np.empty(n, dtype=np.int64)
    left_of[1:] = np.where(v.end[:-1] == v.start[1:], v.low[:-1], v.start[1:] - 1)
    left_of[0] = v.start[0] - 1
    at = alone & left
    high[at] = np.maximum(high[at], right_of[at])
    at = alone & ~left
    low[at] = np.minimum(low[at], left_of[at])
    keep = np.flatnonzero(~taken)
    with_next = joined[keep]
    second = np.minimum(keep + 1, n - 1)
    name = np.where(with_next, mix(v.name[keep] * _A + v.name[second] * _B + _C), v.name[keep])
    return Level(
        name, v.start[keep], np.where(with_next, v.end[second], v.end[keep]), np.where(with_next, np.minimum(low[keep], low[second]), low[keep]),
        np.where(with_next, np.maximum(high[keep], high[second]), high[keep]),
    )


def levels(word: np.ndarray, first: np.ndarray, rounds: int) -> list[Level]:
    """``word``: hashes with one slot before, between and after the documents; ``first``: mask of slots that hold a word."""
    at = np.flatnonzero(first)
    v = Level(word[at], at, at + 1, at, at + 1)
    out = [v]
    for k in range(rounds):
        v = _pairs(_runs(v, word), k)
        out.append(v)
    return out


def _argmin_ranges(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least key in each [lo, hi), hi > lo; the first of equals."""
    span = hi - lo
    depth = np.zeros(len(span), dtype=np.int64)
    for k in range(1, int(span.max()).bit_length()):
        depth[span >= 1 << k] = k
    best = np.arange(len(key))
    out = np.empty(len(span), dtype=np.int64)
    for k in range(int(depth.max()) + 1):
        at = np.flatnonzero(depth == k)
        if len(at):
            a, b = best[lo[at]], best[hi[at] - (1 << k)]
            out[at] = np.where(key[b] < key[a], b, a)
        step = 1 << k
        if len(best) > step:
            a, b = best[:-step], best[step:]
            best = np.where(key[b] < key[a], b, a)
    return out


def anchors(word: np.ndarray, first: np.ndarray, starts: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (its start slot) the name and the place of one symbol whose support lies in the window.

    Taken from the highest level that has any, the least name by hash, the first of equals: all that depends on nothing
    but the words in the window. A single word always qualifies, so no window is left without.
    """
    name = np.zeros(len(starts), dtype=np.uint64)
    place = np.full(len(starts), -1, dtype=np.int64)
    open_ = np.arange(len(starts))
    for k, v in reversed(list(enumerate(levels(word, first, rounds)))):
        if not len(open_):
            break
        lo = np.searchsorted(v.low, starts[open_], side="left")
        hi = np.searchsorted(v.high, starts[open_] + width, side="right")
        some = np.flatnonzero(hi > lo)
        if len(some):
            pick = _argmin_ranges(mix(v.name + np.uint64(77)), lo[some], hi[some])
            name[open_[some]] = mix(v.name[pick] + _times(k, _B))
            place[open_[some]] = v.start[pick]
            open_ = np.delete(open_, some)
    return name, place


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.multiply.accumulate(np.append(np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64))) for b in (base, inverse))
        _POWERS[base] = have = (up, down)
    return have


def window_hashes(word: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` consecutive slots."""
    up, down = _powers(base, len(word) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * down[: len(word) - width + 1])
