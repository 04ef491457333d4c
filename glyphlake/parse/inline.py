"""Inline structure of one leaf block: code, links, emphasis, autolinks, raw HTML and text, with source offsets."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_HTML = re.compile(
    r"""<(?:[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|/[A-Za-z][\w-]*\s*>|!--(?:>|->|.*?-->)|\?.*?\?>|![A-Za-z][^>]*>|!\[CDATA\[.*?\]\]>)""",
    re.S,
)
_DEST = re.compile(r"[ \t\n]*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*))")
_TITLE = re.compile(r"""[ \t\n]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))""", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+", re.I)
EMAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_SPECIAL = re.compile(r"[\\`<\[\]!*_\n]|~~")


def normal_label(label: str) -> str:
    return " ".join(label.split()).lower()


@dataclass(slots=True)
class Piece:
    kind: str  # text, code, html, autolink, break, hard, link, image, em, strong
    start: int
    end: int
    text: str = ""
    a: int = 0
    b: int = 0
    extra: tuple = ()


class Inline:
    """``lines``: (text, offset) of the block. Offsets in results are offsets in the source."""

    def __init__(self, lines: list[tuple[str, int]], refs: dict[str, tuple]):
        self.text = "\n".join(t for t, _ in lines)
        self.starts, self.offsets, at = [], [], 0
        for t, a in lines:
            self.starts.append(at)
            self.offsets.append(a)
            at += len(t) + 1
        self.refs = refs
        self.pieces: list[Piece] = []
        if _SPECIAL.search(self.text):
            self._run()
        else:
            self._texts([])

    def src(self, i: int) -> int:
        if len(self.starts) == 1:
            return self.offsets[0] + i
        k = bisect_right(self.starts, i) - 1
        return self.offsets[k] + i - self.starts[k]

    def _add(self, kind: str, s: int, e: int, text: str = "", a: int = 0, b: int = 0, extra: tuple = ()) -> None:
        self.pieces.append(Piece(kind, s, e, text, a, b, extra))

    def _run(self) -> None:
        t, i, n = self.text, 0, len(self.text)
        delims: list[dict] = []
        brackets: list[dict] = []
        used: list[tuple[int, int]] = []  # syntax that is no text
        ticks: set[int] = set()
        while i < n:
            m = _SPECIAL.search(t, i)
            if not m:
                break
            i, c = m.start(), m[0]
            if c == "\\":
                if i + 1 < n and t[i + 1] == "\n":
                    self._add("hard", i, i + 2)
                    used.append((i, i + 2))
                i += 2
            elif c == "\n":
                s = i
                while s and t[s - 1] == " ":
                    s -= 1
                self._add("hard" if i - s >= 2 else "break", s, i + 1)
                used.append((s, i + 1))
                i += 1
            elif c == "`":
                k = i
                while k < n and t[k] == "`":
                    k += 1
                width, j = k - i, k
                while width not in ticks:
                    j = t.find("`" * width, j)
                    if j < 0:
                        ticks.add(width)
                        break
                    e = j
                    while e < n and t[e] == "`":
                        e += 1
                    if e - j == width:
                        self._add("code", i, e, t[k:j], k, j)
                        used.append((i, e))
                        break
                    j = e
                i = (e if width not in ticks and j >= 0 else k)
            elif c == "<":
                if a := _AUTOLINK.match(t, i):
                    self._add("autolink", i, a.end(), a[1])
                    used.append((i, a.end()))
                    i = a.end()
                elif h := _HTML.match(t, i):
                    self._add("html", i, h.end(), h[0])
                    used.append((i, h.end()))
                    i = h.end()
                else:
                    i += 1
            elif c == "[" or (c == "!" and t.startswith("![", i)):
                width = len(c) if c == "[" else 2
                brackets.append({"at": i, "image": width == 2, "active": True, "delims": len(delims)})
                i += width
            elif c == "]":
                i = self._close(i, brackets, delims, used)
            elif c in "*_" or c == "~~":
                ch, j = c[0], i
                while j < n and t[j] == ch:
                    j += 1
                before, after = (t[i - 1] if i else " "), (t[j] if j < n else " ")
                left = not after.isspace() and (after not in PUNCT or before.isspace() or before in PUNCT)
                right = not before.isspace() and (before not in PUNCT or after.isspace() or after in PUNCT)
                opens = left and (ch != "_" or not right or before in PUNCT)
                closes = right and (ch != "_" or not left or after in PUNCT)
                delims.append({"c": ch, "at": i, "n": j - i, "size": j - i, "open": opens, "close": closes})
                i = j
            else:
                i += 1
        self._emphasis(delims, 0, used)
        self._texts(used)

    def _close(self, i: int, brackets: list, delims: list, used: list) -> int:
        t = self.text
        if not brackets:
            return i + 1
        opener = brackets.pop()
        if not opener["active"]:
            return i + 1
        s = opener["at"] + (2 if opener["image"] else 1)
        end, dest, kind = None, None, None
        if t.startswith("(", i + 1) and (m := _DEST.match(t, i + 2)):
            e = m.end()
            if title := _TITLE.match(t, e):
                e = title.end()
            while e < len(t) and t[e] in " \t\n":
                e += 1
            if t.startswith(")", e):
                angle = m[1] is not None
                ds, de = (m.start(1) - 1, m.end(1) + 1) if angle else (m.start(2), m.end(2))
                end, dest, kind = e + 1, (ds, de), "inline"
        if end is None:
            full = _LABEL.match(t, i + 1)
            label = full[1] if full and full[1].strip() else t[s:i]
            if normal_label(label) in self.refs and "[" not in label.replace("\\[", ""):
                end, kind = full.end() if full else i + 1, "full" if full and full[1].strip() else "collapsed" if full else "shortcut"
        if end is None:
            return i + 1
        self._emphasis(delims, opener["delims"], used)
        del delims[opener["delims"] :]
        self._add("image" if opener["image"] else "link", opener["at"], end, t[s:i], *(dest or (0, 0)), (kind,))
        used += [(opener["at"], s), (i, end)]
        if not opener["image"]:
            for b in brackets:
                if not b["image"]:
                    b["active"] = False
        return end

    def _emphasis(self, delims: list, bottom: int, used: list) -> None:
        k = bottom
        while k < len(delims):
            d = delims[k]
            if not d["close"] or not d["n"]:
                k += 1
                continue
            for j in range(k - 1, bottom - 1, -1):
                o = delims[j]
                if o["c"] != d["c"] or not o["open"] or not o["n"]:
                    continue
                if d["c"] == "~":
                    if o["n"] != d["n"] or o["n"] != 2:
                        continue
                elif (o["close"] or d["open"]) and (o["size"] + d["size"]) % 3 == 0 and (o["size"] % 3 or d["size"] % 3):
                    continue
                width = 2 if o["n"] >= 2 and d["n"] >= 2 else 1
                s, e = o["at"] + o["n"] - width, d["at"] + d["size"] - d["n"]
                kind = "strike" if d["c"] == "~" else "strong" if width == 2 else "em"
                self._add(kind, s, e + width, d["c"], s + width, e)
                used += [(s, s + width), (e, e + width)]
                o["n"] -= width
                d["n"] -= width
                for x in delims[j + 1 : k]:
                    x["n"] = 0
                break
            else:
                if not d["open"]:
                    d["n"] = 0
                k += 1
                continue
            if not d["n"]:
                k += 1

    def _texts(self, used: list) -> None:
        """Text between the syntax, each run in one piece; bare URLs and addresses in it."""
        at = 0
        for s, e in [*sorted(used), (len(self.text), len(self.text))]:
            if s > at:
                self._add("text", at, s, self.text[at:s])
            at = max(at, e)
        links = [(p.start, p.end) for p in self.pieces if p.kind in ("link", "image")]
        for p in [p for p in self.pieces if p.kind == "text"]:
            web, mail = "://" in p.text or "www." in p.text.lower(), "@" in p.text
            if not web and not mail:
                continue
            found = []
            for m in URL.finditer(p.text) if web else ():
                if m.start() and p.text[m.start() - 1] not in " \t\n*_~(\"'":
                    continue
                url = m[0].rstrip("?!.,:*_~'\"")
                while url.endswith(")") and url.count(")") > url.count("("):
                    url = url[:-1].rstrip("?!.,:*_~'\"")
                url = re.sub(r"&[A-Za-z0-9]+;$", "", url)
                host = re.sub(r"^[a-z]+://", "", url, flags=re.I).split("/")[0].split("?")[0]
                if "." in host.strip(".") and "_" not in ".".join(host.split(".")[-2:]):
                    found.append((m.start(), m.start() + len(url), url, "GfmUrl"))
            for m in EMAIL.finditer(p.text) if mail else ():
                if m[0][-1] not in "-_" and not any(a < m.end() and m.start() < b for a, b, *_ in found):
                    found.append((m.start(), m.end(), m[0], "GfmEmail"))
            last = 0
            for s, e, text, kind in sorted(found):
                if s >= last and not any(a <= p.start + s and p.start + e <= b for a, b in links):
                    self._add("gfm", p.start + s, p.start + e, text, extra=(kind,))
                    last = e
