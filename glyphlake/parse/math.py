"""Mathematics in Markdown: delimiters and environments, left to right, outside code and HTML."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

# The environments with a name of their own, and those whose rows have cells to align.
KNOWN = "align align* aligned equation equation* gather gather* matrix pmatrix bmatrix vmatrix smallmatrix cases array split multline multline*".split()
ALIGNING = "align align* aligned matrix pmatrix bmatrix vmatrix smallmatrix cases array split".split()
_OPEN = re.compile(r"\\\[|\\\(|\\begin\{([A-Za-z]+\*?)\}|\\end\{([A-Za-z]+\*?)\}|\\\]|\\\)|\$\$?")


@dataclass
class Region:
    start: int
    end: int
    kind: str
    body_start: int
    body_end: int
    env: str | None = None

    def clean(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
        """The body without container prefixes, and (offset in it, offset in the source) where its pieces begin."""
        parts, pieces, size, at = [], [], 0, self.body_start
        for s, e in [*(r for r in runs if r[1] > self.body_start and r[0] < self.body_end), (self.body_end, self.body_end)]:
            if s > at or not pieces:
                pieces.append((size, at))
                parts.append(text[at : max(s, at)])
                size += len(parts[-1])
            at = max(at, e)
        return "".join(parts), pieces


def source_offset(pieces: list[tuple[int, int]], offset: int) -> int:
    """Where an offset of a clean body lies in the source."""
    clean, source = pieces[bisect_right(pieces, (offset, 1 << 62)) - 1]
    return source + offset - clean


@dataclass
class MathError:
    kind: str
    start: int
    end: int
    name: str


def _escaped(text: str, i: int) -> bool:
    n = 0
    while i - n > 0 and text[i - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def first_unbalanced(body: str) -> int | None:
    """Offset of the first closing brace without an opening one; 0 if one stays open; None if all match."""
    depth, i = 0, 0
    while i < len(body):
        if body[i] == "\\":
            i += 2
            continue
        depth += {"{": 1, "}": -1}.get(body[i], 0)
        if depth < 0:
            return i
        i += 1
    return 0 if depth else None


def scan_math(text: str, exclude: list[tuple[int, int]], dollars: bool = False, runs: list[tuple[int, int]] = ()) -> tuple[list[Region], list[MathError]]:
    starts = [s for s, _ in exclude]
    ends: list[int] = []
    for _, e in exclude:
        ends.append(max(e, ends[-1] if ends else 0))

    def outside(i: int) -> int | None:
        k = bisect_right(starts, i) - 1
        return ends[k] if k >= 0 and i < ends[k] else None

    def find(what: str, i: int, limit: int) -> int:
        while (i := text.find(what, i, limit)) >= 0:
            if outside(i) is None and not _escaped(text, i):
                return i
            i += 1
        return -1

    regions, errors, i = [], [], 0
    while m := _OPEN.search(text, i):
        i = m.start()
        if (past := outside(i)) is not None:
            i = past
            continue
        if _escaped(text, i):
            i += 1
            continue
        token = m[0]
        if token.startswith("$"):
            if not dollars:
                i = m.end()
                continue
            close = find(token, m.end(), len(text))
            para = text.find("\n\n", m.end())
            if close < 0 or (para >= 0 and close > para) or (token == "$" and (text[m.end()].isspace() or text[close - 1].isspace())):
                i = m.end()
                continue
            regions.append(Region(i, close + len(token), "display" if token == "$$" else "inline", m.end(), close))
            i = close + len(token)
        elif token in ("\\[", "\\("):
            want = "\\]" if token == "\\[" else "\\)"
            close = find(want, m.end(), len(text))
            body = text[m.end() : close] if close >= 0 else text[m.end() : m.end() + 40]
            if not re.search("[A-Za-z0-9]", body):
                i = m.end()
            elif close < 0:
                errors.append(MathError("delim", i, m.end(), token))
                i = m.end()
            else:
                regions.append(Region(i, close + 2, "display" if token == "\\[" else "inline", m.end(), close))
                i = close + 2
        elif m[1]:
            depth, at, close = 1, m.end(), None
            for n in re.finditer(r"\\(begin|end)\{" + re.escape(m[1]) + r"\}", text[at:]):
                if outside(at + n.start()) is None:
                    depth += 1 if n[1] == "begin" else -1
                    if not depth:
                        close = (at + n.start(), at + n.end())
                        break
            if close is None:
                errors.append(MathError("env", i, m.end(), m[1]))
                i = m.end()
            else:
                regions.append(Region(i, close[1], "environment", m.end(), close[0], m[1]))
                i = close[1]
        else:
            errors.append(MathError("env" if m[2] else "delim", i, m.end(), m[2] or token))
            i = m.end()
    for r in regions:
        body, pieces = r.clean(text, runs)
        if (bad := first_unbalanced(body)) is not None:
            at = source_offset(pieces, bad)
            errors.append(MathError("braces", at, min(at + 1, r.end), r.env or r.kind))
    return regions, errors
