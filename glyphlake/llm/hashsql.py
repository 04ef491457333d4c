"""CRC32 and XXH64 written out as DuckDB SQL, for the SQL twins of queries that return or use them.

DuckDB has neither function. Both work on a list of bytes, since it also has no access to the bytes of a blob by number.
Sixty-four bit arithmetic is done in 128 bits and cut to the low half after each step.
"""

from __future__ import annotations

# The reflected CRC32 polynomial and the five primes of XXH64.
POLYNOMIAL = 3988292384
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261

_ALL = 2**64 - 1

#: A row with the 256 CRC codes as the list ``codes``.
CRC_CODES = f"""SELECT list(c ORDER BY n) AS codes FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))"""


def bytes_of(text: str, kind: str = "BIGINT") -> str:
    """List of the UTF-8 bytes of a text."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda pair: CAST(CAST('0x' || pair AS BIGINT) AS {kind}))"


def crc32(text: str) -> str:
    """Unsigned CRC32 of a text, beside a column ``codes`` from CRC_CODES."""
    return f"xor({2**32 - 1}, list_reduce([{2**32 - 1}] || {bytes_of(text)}, lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])))"


def _low(x: str) -> str:
    return f"(({x}) & {_ALL}::UHUGEINT)"


def _times(x: str, factor: int) -> str:
    return _low(f"({x}) * {factor}::UHUGEINT")


def _rotated(x: str, k: int) -> str:
    return _low(f"(({x}) * {2**64 + 1}::UHUGEINT) >> {64 - k}")  # the value twice, side by side


def _round(state: str, lane: str) -> str:
    return _times(_rotated(_low(f"({state}) + {_times(lane, P2)}"), 31), P1)


def _lane(at: str, size: int) -> str:
    """The little-endian number in ``size`` bytes from offset ``at``."""
    return " + ".join(f"bs[{at} + {j + 1}] * {256**j}::UHUGEINT" for j in range(size))


def _lanes(start: str, end: str, step: int) -> str:
    return f"list_transform(range({start}, {end}, {step}), lambda o: {_lane('o', 8)})"


def xxh64_steps(source: str, text: str, seed: int, prefix: str = "xx") -> str:
    """Common table expressions from ``source(text)`` to ``<prefix>(text, h)``, h the XXH64 of the text as HUGEINT."""
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    stripes = ", ".join(
        f"list_reduce([{s % 2**64}::UHUGEINT] || {_lanes(str(8 * j), 'n - n % 32', 32)}, lambda a, k: {_round('a', 'k')}) AS v{j}" for j, s in enumerate(starts)
    )
    long = _low(" + ".join(_rotated(f"v{j}", k) for j, k in enumerate((1, 7, 12, 18))))
    for j in range(4):
        long = _low(f"{_times(f'xor({long}, {_round("0", f"v{j}")})', P1)} + {P4}::UHUGEINT")
    eight = _low(f"{_times(_rotated(f'xor(a, {_round("0", "k")})', 27), P1)} + {P4}::UHUGEINT")
    four = _low(f"{_times(_rotated(f'xor(h, {_times(_lane("n - n % 8", 4), P1)})', 23), P2)} + {P3}::UHUGEINT")
    one = _times(_rotated(f"xor(a, {_times('k', P5)})", 11), P1)
    p, t = prefix, text
    return f"""
{p}_bytes AS (SELECT {t}, CAST(octet_length(encode({t})) AS BIGINT) AS n, {bytes_of(t, "UHUGEINT")} AS bs FROM {source}),
{p}_stripes AS (SELECT {t}, n, bs, {stripes} FROM {p}_bytes),
{p}_body AS (SELECT {t}, n, bs, {_low(f"CASE WHEN n >= 32 THEN {long} ELSE {seed + P5}::UHUGEINT END + CAST(n AS UHUGEINT)")} AS h FROM {p}_stripes),
{p}_eights AS (SELECT {t}, n, bs, list_reduce([h] || {_lanes("n - n % 32", "n - n % 8", 8)}, lambda a, k: {eight}) AS h FROM {p}_body),
{p}_four AS (SELECT {t}, n, bs, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {p}_eights),
{p}_ones AS (SELECT {t}, list_reduce([h] || bs[n - n % 4 + 1:], lambda a, k: {one}) AS h FROM {p}_four),
{p}_mixed AS (SELECT {t}, {_times("xor(h, h >> 33)", P2)} AS h FROM {p}_ones),
{p}_again AS (SELECT {t}, {_times("xor(h, h >> 29)", P3)} AS h FROM {p}_mixed),
{p} AS (SELECT {t}, CAST(xor(h, h >> 32) AS HUGEINT) AS h FROM {p}_again)"""
