"""Block structure: containers, leaves and their lines, with character offsets into the source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Line = tuple[str, int]  # text without its line break, offset of its first character

FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-*+]|(\d{1,9})[.)])(?=([ \t]+)|$)")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(
    r"""^ {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$"""
)
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table "
    "tbody td tfoot th thead title tr track ul"
).split()
HTML_STARTS = [
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile("-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"^ {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS)})(?=[\s>]|/>|$)", re.I), None),
    (re.compile(r"""^ {0,3}(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"""), None),
]


@dataclass(slots=True)
class Block:
    kind: str
    start: int
    end: int
    lines: list[Line] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)
    info: dict = field(default_factory=dict)


def split_lines(text: str, start: int = 0) -> list[Line]:
    out, at = [], start
    for part in text.split("\n"):
        out.append((part, at))
        at += len(part) + 1
    if out and out[-1][0] == "" and text.endswith("\n"):
        out.pop()
    return out if text else []


def mark(line: str) -> str:
    """The first character that is no space; what opens a block tells by it whether its pattern can match at all."""
    return line.lstrip(" ")[:1]


def indent(line: str) -> int:
    if line[:1] not in (" ", "\t"):
        return 0
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def blank(line: str) -> bool:
    return not line.strip(" \t")


def strip_indent(line: Line, width: int) -> Line:
    text, at = line
    n = used = 0
    while used < len(text) and n < width and text[used] in " \t":
        n += 1 if text[used] == " " else 4 - n % 4
        used += 1
    return text[used:], at + used


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph above it."""
    c = mark(line)
    if c.isalpha() or not c:
        return False
    if c in "`~":
        return bool((m := FENCE.match(line)) and not ("`" in m[3] and m[2][0] == "`"))
    if c in "*-_+" or c.isdecimal():
        if c in "*-_" and BREAK.match(line):
            return True
        item = ITEM.match(line)
        return bool(item and item[4] and item[3] in (None, "1") and not blank(line[item.end() :]))
    if c == "<":
        return any(a.match(line) for a, _ in HTML_STARTS[:6])
    return bool(c == "#" and ATX.match(line) or c == ">" and QUOTE.match(line))


def _end(line: Line) -> int:
    return line[1] + len(line[0])


def parse_blocks(lines: list[Line], depth: int = 0) -> list[Block]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        text, at = lines[i]
        if blank(text):
            i += 1
            continue
        c = mark(text)
        if c.isalpha() and text[0] == c:
            if i + 1 == len(lines) or blank(lines[i + 1][0]):  # a paragraph of one line
                out.append(Block("paragraph", at, at + len(text), [(text.rstrip(" \t"), at)]))
                i += 2
            else:
                i = _paragraph(lines, i, out)
            continue
        if indent(text) >= 4:
            j = last = i
            while j < len(lines) and (blank(lines[j][0]) or indent(lines[j][0]) >= 4):
                last = j if not blank(lines[j][0]) else last
                j += 1
            out.append(Block("code", at, _end(lines[last]), [strip_indent(x, 4) for x in lines[i : last + 1]], info={"info": "", "fenced": False}))
            i = last + 1
            continue
        if c in "`~" and (m := FENCE.match(text)) and not (m[2][0] == "`" and "`" in m[3]):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j][0]):
                j += 1
            last = min(j, len(lines) - 1)
            out.append(Block("code", at, _end(lines[last]), [strip_indent(x, len(m[1])) for x in lines[i + 1 : j]], info={"info": m[3], "fenced": True}))
            i = j + 1
            continue
        if c == "#" and (m := ATX.match(text)):
            body = m[2] or ""
            s = at + (m.start(2) if m[2] else len(text))
            if not body.strip("#"):
                body = ""
            out.append(Block("heading", at, _end(lines[i]), [(body, s)] if body else [], info={"level": len(m[1]), "setext": False}))
            i += 1
            continue
        if c in "*-_" and BREAK.match(text):
            out.append(Block("break", at, _end(lines[i])))
            i += 1
            continue
        if c == "<" and (found := next(((k, stop) for k, (a, stop) in enumerate(HTML_STARTS) if a.match(text)), None)) is not None:
            _, stop = found
            j = i
            if stop is None:
                while j < len(lines) and not blank(lines[j][0]):
                    j += 1
            else:
                while j < len(lines) and not stop.search(lines[j][0]):
                    j += 1
                j = min(j + 1, len(lines))
            out.append(Block("html", at, _end(lines[j - 1]), lines[i:j]))
            i = j
            continue
        if c == ">" and QUOTE.match(text):
            inner, j, lazy = [], i, False
            while j < len(lines):
                t, a = lines[j]
                if q := QUOTE.match(t):
                    inner.append((t[q.end() :], a + q.end()))
                    lazy = not blank(t[q.end() :]) and not _interrupts(t[q.end() :]) and indent(t[q.end() :]) < 4
                elif lazy and not blank(t) and not _interrupts(t):
                    inner.append((t, a))
                else:
                    break
                j += 1
            out.append(Block("quote", at, _end(lines[j - 1]), lines[i:j], parse_blocks(inner, depth + 1) if depth < 60 else []))
            i = j
            continue
        if (c in "-*+" or c.isdecimal()) and (m := ITEM.match(text)):
            i = _list(lines, i, m, out, depth)
            continue
        i = _paragraph(lines, i, out)
    return out


def _list(lines: list[Line], i: int, m: re.Match, out: list[Block], depth: int) -> int:
    kind = m[2][-1]
    ordered = m[3] is not None
    group = Block("list", lines[i][1], 0, info={"ordered": ordered, "marker": kind, "first": int(m[3] or 0), "loose": False})
    while i < len(lines):
        text, at = lines[i]
        gap = len(m[4] or "")
        pad = gap if m[4] and 1 <= indent(m[4]) <= 4 and not blank(text[m.end() :]) else 1
        width = m.end() + pad
        start = min(len(text), m.end() + pad)
        inner, j = [(text[start:], at + start)], i + 1
        lazy = not blank(inner[0][0])
        last, empty = i, not lazy
        while j < len(lines):
            t, a = lines[j]
            if blank(t):
                if empty and j == i + 1:
                    j += 1
                    break
                inner.append((t[len(t) :], a + len(t)))
                lazy = False
            elif indent(t) >= width:
                inner.append(strip_indent(lines[j], width))
                last, lazy = j, not _interrupts(inner[-1][0])
            elif lazy and not _interrupts(t) and not ITEM.match(t):
                inner.append(lines[j])
                last = j
            else:
                break
            j += 1
        inner = inner[: last - i + 1]
        children = parse_blocks(inner, depth + 1) if depth < 60 else []
        item = Block("item", at + len(m[1]), _end(lines[last]), lines[i : last + 1], children)
        item.info = {"marker_start": at + len(m[1]), "marker_end": at + m.end(), "marker": m[2], "number": int(m[3] or 0), "width": width}
        if len(children) > 1 and any(b.start > a.end and "\n\n" in _between(inner, a, b) for a, b in zip(children, children[1:], strict=False)):
            group.info["loose"] = True
        group.children.append(item)
        group.end = item.end
        i = last + 1
        k = i
        while k < len(lines) and blank(lines[k][0]):
            k += 1
        follows = k < len(lines) and (n := ITEM.match(lines[k][0])) and n[2][-1] == kind and (n[3] is not None) == ordered and not BREAK.match(lines[k][0])
        if follows and k > i:
            group.info["loose"] = True
        if not follows:
            break
        i, m = k, n
    out.append(group)
    return i


def _between(lines: list[Line], a: Block, b: Block) -> str:
    """The lines from the end of ``a`` to the start of ``b``, empty ones as nothing."""
    inside = [t for t, at in lines if at >= a.end and at <= b.start]
    return "\n\n" if any(blank(t) and at < b.start for t, at in lines if a.end <= at) and inside else ""


def _cells(text: str, at: int) -> list[Line]:
    """Cells of a table row as (text, offset), split at unescaped pipes outside code spans."""
    out, start, i, n = [], 0, 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "|":
            out.append((text[start:i], at + start))
            start = i + 1
        i += 1
    out.append((text[start:], at + start))
    if out and blank(out[0][0]) and text.lstrip(" \t").startswith("|"):
        out.pop(0)
    if out and blank(out[-1][0]) and text.rstrip(" \t").endswith("|") and len(out) > 0:
        out.pop()
    return [(t.strip(" \t"), a + len(t) - len(t.lstrip(" \t"))) for t, a in out]


def _paragraph(lines: list[Line], i: int, out: list[Block]) -> int:
    start = i
    while i < len(lines) and mark(lines[i][0]) == "[" and (m := DEFINITION.match(lines[i][0])) and i == start + len([b for b in out if b.kind == "definition" and b.start >= lines[start][1]]):
        at = lines[i][1]
        dest = m[2]
        out.append(Block("definition", at, _end(lines[i]), [lines[i]], info={"label": m[1], "dest": dest[1:-1] if dest[0] == "<" else dest, "title": m[3][1:-1] if m[3] else None, "dest_start": at + m.start(2), "dest_end": at + m.end(2)}))
        i += 1
    if i > start and (i >= len(lines) or blank(lines[i][0]) or _interrupts(lines[i][0]) or ITEM.match(lines[i][0])):
        return i
    if i >= len(lines):
        return i
    first = i
    if i + 1 < len(lines) and "|" in lines[i][0] and DELIMITER.match(lines[i + 1][0]) and ("|" in lines[i + 1][0] or ":" in lines[i + 1][0] or "-" in lines[i + 1][0]):
        head, rule = _cells(*lines[i]), _cells(*lines[i + 1])
        if len(head) == len(rule):
            j = i + 2
            while j < len(lines) and not blank(lines[j][0]) and not _interrupts(lines[j][0]):
                j += 1
            align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "none") for c, _ in rule]
            rows = [_cells(*x) for x in lines[i:j]]
            out.append(Block("table", lines[i][1], _end(lines[j - 1]), lines[i:j], info={"align": align, "rows": rows}))
            return j
    while i < len(lines) and not blank(lines[i][0]):
        if i > first:
            if mark(lines[i][0]) in ("=", "-") and (s := SETEXT.match(lines[i][0])):
                body = [strip_indent(x, indent(x[0])) for x in lines[first:i]]
                out.append(Block("heading", lines[first][1], _end(lines[i]), body, info={"level": 1 if s[1][0] == "=" else 2, "setext": True}))
                return i + 1
            if _interrupts(lines[i][0]):
                break
        i += 1
    body = [strip_indent(x, indent(x[0])) for x in lines[first:i]]
    if body:
        body[-1] = (body[-1][0].rstrip(" \t"), body[-1][1])
        out.append(Block("paragraph", lines[first][1], _end(lines[i - 1]), body))
    return i
