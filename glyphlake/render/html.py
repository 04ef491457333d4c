"""HTML of a parsed document in two spellings: ``default``, and ``gfm`` (quotes and targets escaped, tables one tag a line)."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from glyphlake.parse.blocks import Block
from glyphlake.parse.facts import Options, Parsed, parse
from glyphlake.parse.inline import Inline, Piece, normal_label

FILTERED = "title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext"
_FILTER = re.compile(rf"<(?=/?(?:{FILTERED})(?:\s|>|/))", re.I)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])|(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)")
_TASK = re.compile(r"\[([ xX])\][ \t]")


def plain(raw: str) -> str:
    """Source text without backslash escapes and character references."""
    return _ESCAPE.sub(lambda m: m[1] or entities.unescape(m[2]), raw)


def href(url: str) -> str:
    """A target as it stands in an attribute: reserved characters stay, unsafe ones are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,-./:;=?@_~").replace("&", "&amp;").replace("'", "&#x27;")


class Renderer:
    def __init__(self, doc: Parsed, profile: str = "default", options: Options | None = None):
        self.doc, self.gfm, self.options = doc, profile == "gfm", options or Options()
        self.inlines: dict[int, list[Inline]] = {}
        for b, line in doc.inlines:
            self.inlines.setdefault(id(b), []).append(line)

    def text(self, s: str) -> str:
        s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return s.replace('"', "&quot;") if self.gfm else s

    def attribute(self, s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def target(self, url: str) -> str:
        return href(url) if self.gfm else self.attribute(url)

    def raw(self, s: str) -> str:
        return _FILTER.sub("&lt;", s) if self.gfm else s

    def link(self, line: Inline, p: Piece) -> tuple[str, str | None]:
        """Target and title of a link or image."""
        t, close = line.text, p.start + (2 if p.kind == "image" else 1) + len(p.text)
        if p.extra[0] == "inline":
            dest = t[p.a : p.b]
            title = re.search(r"""[ \t\n]("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))[ \t\n]*\)$""", t[p.b : p.end], re.S)
            return plain(dest[1:-1] if dest.startswith("<") else dest), plain(title[1][1:-1]) if title else None
        label = t[close + 2 : p.end - 1] if p.extra[0] == "full" else p.text
        dest, title = line.refs[normal_label(label)]
        return plain(dest), plain(title) if title is not None else None

    def inline(self, line: Inline, lo: int = 0, hi: int | None = None, alt: bool = False) -> str:
        hi = len(line.text) if hi is None else hi
        out, at = [], lo
        for p in sorted((p for p in line.pieces if p.kind != "gfm" and lo <= p.start and p.end <= hi), key=lambda p: (p.start, -p.end)):
            if p.start < at:
                continue
            at = p.end
            if p.kind == "text":
                out.append(plain(p.text) if alt else self.words(line, p))
            elif p.kind in ("break", "hard"):
                out.append("<br />\n" if p.kind == "hard" and not alt else "\n")
            elif p.kind == "code":
                body = p.text.replace("\n", " ")
                body = body[1:-1] if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" ") else body
                out.append(body if alt else f"<code>{self.text(body)}</code>")
            elif p.kind == "html":
                out.append("" if alt else self.raw(p.text))
            elif p.kind == "autolink":
                url = p.text if re.match(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:", p.text) else f"mailto:{p.text}"
                out.append(p.text if alt else f'<a href="{self.target(url)}">{self.text(p.text)}</a>')
            elif p.kind in ("em", "strong", "strike"):
                tag = {"em": "em", "strong": "strong", "strike": "del"}[p.kind]
                inner = self.inline(line, p.a, p.b, alt)
                out.append(inner if alt else f"<{tag}>{inner}</{tag}>")
            else:
                dest, title = self.link(line, p)
                s = p.start + (2 if p.kind == "image" else 1)
                named = f' title="{self.attribute(title)}"' if title is not None else ""
                inner = self.inline(line, s, s + len(p.text), alt or p.kind == "image")
                if alt:
                    out.append(inner)
                elif p.kind == "image":
                    out.append(f'<img src="{self.target(dest)}" alt="{self.attribute(inner)}"{named} />')
                else:
                    out.append(f'<a href="{self.target(dest)}"{named}>{inner}</a>')
        return "".join(out)

    def words(self, line: Inline, p: Piece) -> str:
        """A run of text; what looks like an address in it becomes a link."""
        out, at = [], p.start
        for g in line.pieces:
            wanted = self.options.autolinks == "urls-and-emails" or (self.options.autolinks == "urls" and g.extra[:1] == ("GfmUrl",))
            if g.kind == "gfm" and wanted and p.start <= g.start and g.end <= p.end:
                url = f"mailto:{g.text}" if g.extra[0] == "GfmEmail" else g.text if "://" in g.text else f"http://{g.text}"
                out += [self.text(plain(line.text[at : g.start])), f'<a href="{self.target(url)}">{self.text(g.text)}</a>']
                at = g.end
        return "".join([*out, self.text(plain(line.text[at : p.end]))])

    def task(self, item: Block) -> str | None:
        """The box of a task item, whose mark is then left out of its text."""
        first = item.children[0] if item.children else None
        if first is None or first.kind != "paragraph" or not (m := _TASK.match(first.lines[0][0])):
            return None
        checked = 'checked="" ' if m[1] in "xX" else ""
        return f'<input type="checkbox" {checked}disabled="" /> ' if self.gfm else f'<input disabled="" type="checkbox" {checked}/>\n'

    def blocks(self, blocks: list[Block], tight: bool = False) -> str:
        out = []
        for k, b in enumerate(blocks):
            if tight and b.kind == "paragraph":
                out.append("".join(self.inline(x) for x in self.inlines.get(id(b), [])) + ("\n" if k + 1 < len(blocks) else ""))
            else:
                if tight and k == 0:
                    out.append("\n")
                out.append(self.block(b))
        return "".join(out)

    def block(self, b: Block) -> str:
        inner = self.inlines.get(id(b), [])
        if b.kind == "paragraph":
            return f"<p>{''.join(map(self.inline, inner))}</p>\n"
        if b.kind == "heading":
            body, attrs = "".join(map(self.inline, inner)), ""
            if self.options.heading_attributes and b.lines and (m := re.search(r"\s*\{([^{}]*)\}\s*$", b.lines[-1][0])):
                parts = m[1].split()
                ids, classes = [x[1:] for x in parts if x[0] == "#"], [x[1:] for x in parts if x[0] == "."]
                attrs = (f' id="{self.attribute(ids[-1])}"' if ids else "") + (f' class="{self.attribute(" ".join(classes))}"' if classes else "")
                attrs += "".join(f' {x.split("=", 1)[0]}="{self.attribute(x.split("=", 1)[1] if "=" in x else "")}"' for x in parts if x[0] not in "#.")
                body = body[: len(body) - len(self.text(plain(m[0])))]
            return f"<h{b.info['level']}{attrs}>{body}</h{b.info['level']}>\n"
        if b.kind == "code":
            language = plain(b.info["info"].split(" ")[0]) if b.info["info"] else ""
            named = f' class="language-{self.attribute(language)}"' if language else ""
            return f"<pre><code{named}>{''.join(self.text(t) + chr(10) for t, _ in b.lines)}</code></pre>\n"
        if b.kind == "html":
            return self.raw("".join(t + "\n" for t, _ in b.lines))
        if b.kind == "break":
            return "<hr />\n"
        if b.kind == "quote":
            return f"<blockquote>\n{self.blocks(b.children)}</blockquote>\n"
        if b.kind == "list":
            tag = "ol" if b.info["ordered"] else "ul"
            start = f' start="{b.info["first"]}"' if b.info["ordered"] and b.info["first"] != 1 else ""
            items = []
            for item in b.children:
                body = self.blocks(item.children, not b.info["loose"])
                if box := self.task(item):
                    body = re.sub(r"\[[ xX]\][ \t]", lambda _, box=box: box, body, count=1)
                items.append(f"<li>{chr(10) if b.info['loose'] and item.children else ''}{body}</li>\n")
            return f"<{tag}{start}>\n{''.join(items)}</{tag}>\n"
        if b.kind == "table":
            return self.table(b, inner)
        return ""

    def table(self, b: Block, inner: list[Inline]) -> str:
        align, cells, rows = b.info["align"], iter(inner), []
        for k, row in enumerate(b.info["rows"]):
            if k == 1:
                continue
            shown = [self.inline(next(cells)).replace("\\|", "|") if t else "" for t, _ in row]
            rows.append((shown + [""] * len(align))[: len(align)])
        nl = "\n" if self.gfm else ""

        def cell(tag: str, t: str, a: str) -> str:
            how = "" if a == "none" else f' align="{a}"' if self.gfm else f' style="text-align: {a}"'
            return f"<{tag}{how}>{t}</{tag}>{nl}"

        def line(tag: str, row: list[str]) -> str:
            return f"<tr>{nl}{''.join(cell(tag, t, a) for t, a in zip(row, align, strict=True))}</tr>{nl}"

        body = "".join(line("td", r) + ("" if self.gfm else "\n") for r in rows[1:])
        out = f"<table>{nl}<thead>{nl}{line('th', rows[0])}</thead>{nl if self.gfm else ''}"
        if rows[1:] or not self.gfm:
            out += f"<tbody>\n{body}</tbody>{nl}"
        return out + "</table>\n"


def html_of(text: str, profile: str = "default", options: Options | None = None) -> str:
    doc = parse(text, options)
    return Renderer(doc, profile, options).blocks(doc.blocks)


def rendered(docs: DataFrame, profile: str = "default", options: Options | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, html). A document that cannot be parsed gives a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(html_of(text or "", profile, options))
                except (RecursionError, ValueError, IndexError, KeyError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, html string")


_TAG, _ATTRIBUTE, _OFF = "\x1b[34m", "\x1b[36m", "\x1b[0m"


def highlighted(html: str) -> str:
    """HTML with terminal colours: tags blue, quoted attribute values cyan."""

    def tag(m: re.Match) -> str:
        return _TAG + re.sub(r'"[^"]*"', lambda v: f"{_ATTRIBUTE}{v[0]}{_TAG}", m[0]) + _OFF

    return re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", tag, html, flags=re.S)


@F.pandas_udf(StringType())
def highlighted_column(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else highlighted(h))
