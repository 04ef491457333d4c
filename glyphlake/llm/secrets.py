"""Secret scanning: known shapes, and a battery of randomness tests under false-discovery control.

Known shapes (assignments, access keys, long hex runs) are always reported. Besides, every other unbroken token of 20 or
more characters is a candidate. Its encoding is inferred (hex, base 32, one-case or mixed alphanumeric, base 64), and three
tests ask how far its symbols are from uniform and independent: chi-squared over the alphabet, runs about the alphabet's
middle, and lag-1 serial correlation. Together they give one statistic that is small for random strings.

How often running text looks as random as that is counted over the whole corpus: windows of 128 letters start at every
64th letter of every document (candidates left out), and the statistic of each one's first n letters is counted for every
n from 20 to 128, or as far as the text goes, as a histogram. A candidate's p-value is the share of text windows of its own
length (128 for longer ones) with a statistic as small; short tokens have large p-values by themselves. The Benjamini-Hochberg procedure over all candidates of the corpus then sets the cut. Decimal numbers are
not secrets and are no candidates.

Two scans, no shuffle but that of the histogram, which has at most 2 * 109 * 120 rows. Defined results: null text is
empty; repeated rows are each reported; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import map_texts

KINDS = ("assign", "access", "hex", "random")
_ANY_CASE = "".join
_ASSIGN = re.compile(
    "(" + "|".join(_ANY_CASE(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LENGTHS = range(20, 129)
STEP = 64
BINS = 120

_ORDER = np.zeros(128, dtype=np.int64)
for _k, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"):
    _ORDER[ord(_c)] = _k
_ORDER[ord("-")], _ORDER[ord("_")] = 62, 63
_DROP = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def symbols(token: str) -> tuple[str, np.ndarray, int] | None:
    """Inferred encoding, symbol numbers and alphabet size; None for numbers and mere filling."""
    body = token.strip("=")
    kinds = (bool(re.search("[0-9]", body)), bool(re.search("[a-z]", body)), bool(re.search("[A-Z]", body)), bool(re.search("[+/_-]", body)))
    if not (kinds[1] or kinds[2]):
        return None
    x = _ORDER[np.frombuffer(body.encode("ascii"), dtype=np.uint8)]
    if not kinds[3] and re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        return "hex", np.where(x >= 36, x - 26, x), 16
    if kinds == (True, False, True, False) and re.fullmatch("[A-Z2-7]+", body):
        return "base32", np.where(x >= 36, x - 36, x + 24), 32
    if kinds[3] and kinds[:3] != (False, True, False) and kinds[:3] != (False, False, True):
        return "base64", x, 64
    x = x[(x < 62)]
    if kinds[1] and kinds[2]:
        return ("alnum", x, 62) if kinds[0] else ("letters", np.where(x >= 36, x - 10, x - 10), 52)
    x = np.where(x >= 36, x - 26, x)
    return ("alnum", x, 36) if kinds[0] else ("letters", x - 10, 26)


def statistic(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of symbol numbers in [0, k) -> one number a row, small where the symbols look uniform and independent."""
    rows, n = x.shape
    counts = np.bincount((x + k * np.arange(rows)[:, None]).ravel(), minlength=rows * k).reshape(rows, k)
    chi = ((counts.astype(np.float64) ** 2).sum(axis=1) * k / n - n - (k - 1)) / np.sqrt(2.0 * (k - 1))
    high = x >= (k + 1) // 2
    n1 = high.sum(axis=1).astype(np.float64)
    n2 = n - n1
    runs = 1.0 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    both = 2 * n1 * n2
    with np.errstate(divide="ignore", invalid="ignore"):
        run_z = (runs - both / n - 1) / np.sqrt(both * (both - n) / (n * n * (n - 1.0)))
        c = x - x.mean(axis=1, keepdims=True)
        serial = (c[:, 1:] * c[:, :-1]).sum(axis=1) / (c * c).sum(axis=1) * np.sqrt(n)
    run_z = np.where(np.isfinite(run_z), run_z, 10.0)
    serial = np.where(np.isfinite(serial), serial, 10.0)
    return np.maximum(chi, 0) ** 2 + run_z**2 + serial**2


def _bin(t: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(1 + t) * 10).astype(np.int64), BINS - 1)


def length_class(n: int) -> int:
    return min(n, LENGTHS[-1]) - LENGTHS[0]


def prefix_statistics(x: np.ndarray, k: int) -> np.ndarray:
    """``statistic`` of the first n symbols of each row, for every n of LENGTHS up to the row's width: (rows, lengths)."""
    rows, width = x.shape
    counts, at = np.zeros((rows, k)), np.arange(rows)
    rank = np.empty((rows, width))
    for i in range(width):  # how often a row's symbol has come before
        rank[:, i] = counts[at, x[:, i]]
        counts[at, x[:, i]] += 1
    n = np.arange(LENGTHS[0], width + 1).astype(np.float64)
    upto = slice(LENGTHS[0] - 1, width)
    y = x.astype(np.float64)
    high = x >= (k + 1) // 2
    products, changes = np.zeros((rows, width)), np.zeros((rows, width))
    products[:, 1:] = y[:, 1:] * y[:, :-1]
    changes[:, 1:] = high[:, 1:] != high[:, :-1]
    chi = (np.cumsum(2 * rank + 1, axis=1)[:, upto] * k / n - n - (k - 1)) / np.sqrt(2.0 * (k - 1))
    n1 = np.cumsum(high, axis=1)[:, upto].astype(np.float64)
    both = 2 * n1 * (n - n1)
    runs = 1.0 + np.cumsum(changes, axis=1)[:, upto]
    total = np.cumsum(y, axis=1)[:, upto]
    with np.errstate(divide="ignore", invalid="ignore"):
        run_z = (runs - both / n - 1) / np.sqrt(both * (both - n) / (n * n * (n - 1.0)))
        lagged = n * np.cumsum(products, axis=1)[:, upto] - total * (2 * total - y[:, :1] - y[:, upto]) + (n - 1) * total * total / n
        serial = lagged / (n * np.cumsum(y * y, axis=1)[:, upto] - total * total) * np.sqrt(n)
    run_z = np.where(np.isfinite(run_z), run_z, 10.0)
    serial = np.where(np.isfinite(serial), serial, 10.0)
    return np.maximum(chi, 0) ** 2 + run_z**2 + serial**2


def text_windows(texts: list[np.ndarray], most: int = 1024) -> np.ndarray:
    """Counts of the statistic's bins for every length, over the windows of some texts (as letter numbers)."""
    total = np.zeros((len(LENGTHS), BINS), dtype=np.int64)
    width = LENGTHS[-1]
    parts = [x[k : k + width] for x in texts for k in range(0, len(x) - LENGTHS[0] + 1, STEP)]
    for first in range(0, len(parts), most):
        some = parts[first : first + most]
        sizes = np.array([len(p) for p in some])
        x = np.zeros((len(some), width), dtype=np.int64)
        x[np.arange(width) < sizes[:, None]] = np.concatenate(some)
        bins = _bin(prefix_statistics(x, 26)) + BINS * np.arange(len(LENGTHS))
        total += np.bincount(bins[np.array(LENGTHS) <= sizes[:, None]], minlength=total.size).reshape(total.shape)
    return total


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the statistic) of each token that could be random."""
    out = []
    for m in _TOKEN.finditer(text):
        found = symbols(m[0])
        if found is not None and len(found[1]) >= LENGTHS[0]:
            out.append((m.start(), m.end(), length_class(len(found[1])), int(_bin(statistic(found[1][None, :], found[2]))[0])))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start() + h.start(), 2, m.start() + h.end()) for m in _TOKEN.finditer(text) for h in _HEX.finditer(m[0])]
    return sorted(out)


def _histogram(docs: DataFrame, text_col: str) -> np.ndarray:
    """counts[0]: text windows, counts[1]: candidates; by length class and bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(LENGTHS), BINS), dtype=np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for text in batch["_text"]:
                if not text:
                    continue
                words = _TOKEN.sub(" ", text)  # candidates are no running text
                held.append(np.frombuffer(words.encode("utf-8", "surrogatepass").translate(_LOWER, _DROP), dtype=np.uint8).astype(np.int64) - 97)
                for _, _, k, b in candidates(text):
                    total[1, k, b] += 1
                if sum(map(len, held[-64:])) > 1 << 16 or len(held) >= 64:
                    total[0] += text_windows(held)
                    held.clear()
        total[0] += text_windows(held)
        at = np.nonzero(total)
        yield pd.DataFrame({"what": at[0], "k": at[1], "b": at[2], "n": total[at]})

    counted = docs.select(F.col(text_col).alias("_text")).mapInPandas(run, "what int, k int, b int, n long")
    out = np.zeros((2, len(LENGTHS), BINS), dtype=np.int64)
    for what, k, b, n in counted.groupBy("what", "k", "b").agg(F.sum("n")).collect():  # at most 2 * 109 * 120 rows
        out[what, k, b] = n
    return out


def cut_bins(counts: np.ndarray, rate: float) -> list[int]:
    """Per length class, the largest bin that is still a discovery (-1: none) at that false-discovery rate."""
    text, tokens = counts
    p = (1 + np.cumsum(text, axis=1)) / (1 + text.sum(axis=1, keepdims=True))
    m = tokens.sum()
    best = 0.0
    flat = sorted((p[k, b], tokens[k, b]) for k, b in zip(*np.nonzero(tokens), strict=True))
    seen = 0
    for value, n in flat:  # Benjamini-Hochberg: the largest p with p <= rank * rate / m
        seen += int(n)
        if value <= rate * seen / m:
            best = float(value)
    return [int((p[k] <= best).sum()) - 1 if best else -1 for k in range(len(LENGTHS))]


def all_spans(text: str | None, cuts: list[int]) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    more = [(s, 3, e) for s, e, k, b in candidates(text) if b <= cuts[k] and not any(x < e and s < y for x, _, y in base)]
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    reach = [list(spans[0])]
    for s, k, e in spans[1:]:
        if s < reach[-1][2]:
            reach[-1][2] = max(reach[-1][2], e)
        else:
            reach.append([s, k, e])
    for s, k, e in reach:
        out += [text[at:s], f"[{KINDS[k]} removed]"]
        at = e
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, rate: float = 0.01, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_random, base_sha256, spans, clean_text; and ``keep``."""
    cuts = cut_bins(_histogram(docs, text_col), rate)

    def run(text: str | None) -> tuple:
        spans = all_spans(text, cuts)
        kinds = [k for _, k, _ in spans]
        sha = hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
        return (*(kinds.count(k) for k in range(4)), sha, joined(spans), redacted(text, spans))

    fields = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, clean_text string"
    return map_texts(docs, text_col, {c: c for c in dict.fromkeys([id_col, *(keep or [])])}, fields, run)
