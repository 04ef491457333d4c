"""Text functions as column expressions, and the few that Spark lacks as Arrow UDFs."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: an expression inside a lambda is computed again for every element."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, block: int = 64) -> Column:
    """What stands before each element of an array of integers, as sums. Block by block, so appending stays cheap."""

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def blocks(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(block)), lambda k: F.slice(all_, k, F.lit(block)))
        return let(parts, lambda p: let(sums(F.transform(p, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)), F.lit(0)), lambda at: F.flatten(F.transform(p, lambda b, k: sums(b, at[k])))))

    return let(sizes, blocks)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: all matches of a pattern that never matches nothing, with byte offsets.

    Each text is searched twice, and offsets are running sums: the work grows with the text, not with its matches times it.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = x["at"][i] + F.octet_length(x["gaps"][i])
            return F.struct(start.alias("s"), (start + F.octet_length(m)).alias("e"), m.alias("m"))

        return F.transform(x["found"], one)

    def summed(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: F.octet_length(m) + F.octet_length(x["gaps"][i]))
        return let(F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), running(sizes).alias("at")), placed)

    return let(F.struct(found.alias("found"), gaps.alias("gaps")), summed)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def normal_label(x: Column) -> Column:
    """A link label's normal form; null if it is empty or has over 999 characters."""
    return F.when(F.length(x) <= 999, F.nullif(F.lower(collapse(x)), F.lit("")))


def trim_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"[.,;:!?]+$", "")


def trailing_newlines(x: Column) -> Column:
    return F.length(F.regexp_extract(x, r"(\n*)[ \t]*$", 1))


def occurrences(x: Column, needle: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def bytes_of(x: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.decode(F.substring(F.encode(x, "UTF-8"), start + 1, end - start), "UTF-8")


def one_line(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("\\n"))


def rule_url(base: str, rule: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/rules/"), rule, F.lit(".html"))


def escaped(x: Column, at: Column) -> Column:
    """Whether the byte at offset ``at`` has an odd run of backslashes before it."""
    return F.length(F.regexp_extract(F.decode(F.substring(F.encode(x, "UTF-8"), F.lit(1), at), "UTF-8"), r"(\\*)$", 1)) % 2 == 1


def greedy_from_the_end(edits: Column) -> Column:
    """Of array<struct<s, ord, e, r>> the edits that do not overlap one taken before, from the end of the text backwards."""
    order = F.array_sort(edits, lambda a, b: F.when(a["s"] != b["s"], b["s"] - a["s"]).otherwise(a["ord"] - b["ord"]))
    start = F.struct(F.lit(2147483647).alias("last"), F.expr("cast(array() as array<struct<s:int,ord:int,e:int,r:string>>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["e"] <= acc["last"]
        return F.struct(F.when(fits, x["s"]).otherwise(acc["last"]).alias("last"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(order, start, step)["kept"]


def splice(text: Column, edits: Column) -> Column:
    """Apply edits that do not overlap, ordered from the last to the first, by bytes."""

    def put(t: Column, x: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), x["s"]), F.encode(x["r"], "UTF-8"), F.substring(t, x["e"] + 1, F.octet_length(t)))

    return F.decode(F.aggregate(edits, F.encode(text, "UTF-8"), put), "UTF-8")


def width_of(text: str | None) -> int | None:
    if text is None:
        return None
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@F.pandas_udf(IntegerType())
def display_width(x: pd.Series) -> pd.Series:
    """Columns on a terminal: wide characters two, combining ones none."""
    return x.map(width_of).astype("Int32")


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro + min(same, 4) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def unified_diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff(o.splitlines(True), n.splitlines(True), f"a/{p}", f"b/{p}")) for p, o, n in zip(path, old, new, strict=True)])


@F.pandas_udf(StringType())
def percent_encode(x: pd.Series) -> pd.Series:
    """A link target as HTML shows it: reserved characters stay, what is unsafe is escaped."""
    from urllib.parse import quote

    return x.map(lambda u: None if u is None else quote(u, safe="!#$%&'()*+,-./:;=?@_~").replace("&", "&amp;").replace("'", "&#x27;"))


def canonical_attributes(trailer: Column) -> Column:
    """The inside of a heading's attribute trailer in order: the last id, classes, then the rest."""
    words = F.split(strip(trailer), r"\s+")
    ids = F.filter(words, lambda w: w.startswith("#"))
    last = F.when(F.size(ids) > 0, F.slice(ids, F.size(ids), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))
    rest = F.filter(words, lambda w: ~w.startswith("#") & ~w.startswith(".") & (w != ""))
    return F.array_join(F.concat(last, F.filter(words, lambda w: w.startswith(".")), rest), " ")


def is_admonition(line: Column) -> Column:
    """Whether a line opens a marked note, which is not wrapped."""
    return line.rlike(r"^(?:!!!|\?\?\?)\+? ")


def first_difference(a: Column, b: Column) -> Column:
    """struct<at, old, new> of the first place where two arrays differ; null if they are equal."""
    both = F.transform(F.arrays_zip(a.alias("old"), b.alias("new")), lambda x, i: F.struct(i.alias("at"), x["old"].alias("old"), x["new"].alias("new")))
    return F.try_element_at(F.filter(both, lambda x: ~x["old"].eqNullSafe(x["new"])), F.lit(1))


def same_ignoring_case(a: Column, b: Column) -> Column:
    """Equal but for the case of ASCII letters."""
    return ascii_lower(a) == ascii_lower(b)


def first_word(info: Column) -> Column:
    """What stands before the first comma, blank or tab."""
    return F.split(info, "[, \t]", 2)[0]


def count_at_start(x: Column, kind: str) -> Column:
    return F.length(F.regexp_extract(x, f"^(?:{kind})*", 0))


def count_at_end(x: Column, kind: str) -> Column:
    return F.length(F.regexp_extract(x, rf"(?:{kind})*\z", 0))


def byte_at(x: Column, at: Column) -> Column:
    """The byte at an offset as a number; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(F.encode(x, "UTF-8"), at + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


def is_char_boundary(x: Column, at: Column) -> Column:
    """Whether a character begins at the byte offset, or the text ends there."""
    return F.coalesce(byte_at(x, at).bitwiseAND(F.lit(0xC0)) != 0x80, at == F.octet_length(x))


def replace_range(x: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with the bytes from ``start`` to ``end`` replaced."""
    return F.decode(F.overlay(F.encode(x, "UTF-8"), F.encode(new, "UTF-8"), start + 1, end - start), "UTF-8")


def centred(x: Column, width: Column) -> Column:
    gap = F.greatest(width - F.length(x), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), x, F.repeat(F.lit(" "), gap - left))


def json_string(x: Column) -> Column:
    """The text as a JSON string with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def suppress_marker(rule: Column) -> Column:
    return F.concat(F.lit("<!-- lint: allow "), rule, F.lit(" -->"))


def severity(advisory: Column) -> Column:
    return F.when(advisory, "advisory").otherwise("warning")


def line_range(x: Column) -> Column:
    """struct<line, col, end_line, end_col> of ``LINE:COL-LINE:COL``; null if it is not of that form."""
    part = lambda k: F.regexp_extract(x, r"^(\d+):(\d+)-(\d+):(\d+)$", k).try_cast("int")
    return F.when(x.rlike(r"^\d+:\d+-\d+:\d+$"), F.struct(*(part(k).alias(n) for k, n in enumerate(("line", "col", "end_line", "end_col"), 1))))


def is_plain_suffix(after: Column) -> Column:
    """Whether what follows a code span is an English plural or possessive ending."""
    return after.rlike("^'?s(?:[^A-Za-z]|$)")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def clamped(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def marker_number(marker: Column) -> Column:
    """The number of an ordered list marker such as ``3.`` or ``3)``; null if there is none."""
    return F.regexp_replace(marker, "[.)]$", "").try_cast("bigint")


def has_all(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) == bits


def windows(x: Column) -> Column:
    """Pairs of neighbours in an array as array<struct<a, b>>."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(x, F.lit(1), n).alias("a"), F.slice(x, F.lit(2), n).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))


def partition_point(ordered: Column, x: Column) -> Column:
    """How many elements of an ascending array are at most ``x``."""
    return F.size(F.filter(ordered, lambda e: e <= x))


def inserted(m: Column, key: str, value: Column) -> Column:
    """The map with a key added if it was absent."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(F.lit(key), value)))


def removed(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)
