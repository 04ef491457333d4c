"""All facts of one document, as lists of plain records with byte ranges."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import accumulate

from glyphlake.parse.blocks import QUOTE, Block, blank, parse_blocks, split_lines
from glyphlake.parse.inline import Inline, normal_label

_DIRECTIVE = re.compile(r"^ {0,3}<!--\s*lint:\s*(allow-next-line|allow|disable-all|disable|enable-all|enable)\b[ \t]*([^>]*?)\s*-->\s*$")
ADMONITION = re.compile(r"(?:!!!|\?\?\?)\+? ")
SOLID = ("code", "link", "image", "html", "autolink")  # what wrapping never breaks
_WIDE = re.compile(r"[^\x00-\x7f]")
_BLANK_END = re.compile(r"(?<![ \t])[ \t]++(?=\n|\Z)")
_KEY = re.compile(r"^\s*[\w\"'.-]+\s*[:=]")


@dataclass
class Options:
    """What the parser recognises; the defaults are GFM with TeX delimiters for mathematics."""

    autolinks: str = "urls-and-emails"  # urls, disabled
    math: str = "tex"  # github adds dollars
    tables: bool = True
    heading_attributes: bool = True
    definition_lists: bool = False


@dataclass
class Parsed:
    text: str
    blocks: list[Block]
    facts: dict[str, list[dict]] = field(default_factory=dict)
    front: tuple[int, int] | None = None
    nodes: list[tuple[Block, int, Block | None]] = field(default_factory=list)  # all blocks, with depth and owner
    tells: re.Pattern | None = None  # blocks in which it finds nothing are left out of ``inlines``

    @cached_property
    def inlines(self) -> list[tuple[Block, Inline]]:
        """The inline structure of paragraphs, headings and cells, in order; made when it is first read."""
        refs: dict[str, tuple] = {}
        for b, _, _ in self.nodes:
            if b.kind == "definition":
                refs.setdefault(normal_label(b.info["label"]), (b.info["dest"], b.info["title"]))
        tell = self.tells.search if self.tells else None
        out: list[tuple[Block, Inline]] = []
        for b, _, _ in self.nodes:
            if b.kind in ("paragraph", "heading") and b.lines:
                if tell is None or tell(b.lines[0][0]) or len(b.lines) > 1 and any(tell(t) for t, _ in b.lines[1:]):
                    out.append((b, Inline(b.lines, refs)))
            elif b.kind == "table":
                for k, row in enumerate(b.info["rows"]):
                    if k != 1:
                        out += [(b, Inline([cell], refs)) for cell in row if cell[0] and (tell is None or tell(cell[0]))]
        return out


@lru_cache(maxsize=64)
def _tells(marks: str) -> re.Pattern:
    """Finds something in each line that has inline syntax, a URL, an address or one of the ``marks``."""
    return re.compile(r"[\\`<\[\]!*_@" + re.escape(marks) + r"]|~~|://|www\.", re.I)


@lru_cache(maxsize=64)
def _one_of(marks: str) -> re.Pattern:
    return re.compile(f"[{re.escape(marks)}]")


def canonical(text: str) -> str:
    """CRLF and CR become LF, NUL becomes the replacement character."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")


def front_matter(text: str) -> tuple[int, str] | None:
    """End and delimiter kind of a leading YAML or TOML block that has at least one key."""
    for mark, ends, kind in (("---", ("---", "..."), "yaml"), ("+++", ("+++",), "toml")):
        if not text.startswith(mark):
            continue
        lines = text.split("\n")
        if lines[0].rstrip(" \t") == mark:
            at = len(lines[0]) + 1
            for k, line in enumerate(lines[1:], 1):
                at += len(line) + 1
                if line.rstrip(" \t") in ends:
                    return (min(at, len(text)), kind) if any(_KEY.match(x) for x in lines[1:k]) else None
    return None


def walk(blocks: list[Block], depth: int = 0, owner: Block | None = None, out: list | None = None) -> list[tuple[Block, int, Block | None]]:
    """Each block before its children, with its depth and owner."""
    out = [] if out is None else out
    for b in blocks:
        out.append((b, depth, owner))
        if b.children:
            walk(b.children, depth + 1, b, out)
    return out


def untabled(blocks: list[Block]) -> list[Block]:
    """Tables as the paragraphs they are without the extension."""
    for b in blocks:
        b.children = untabled(b.children)
    return [Block("paragraph", b.start, b.end, b.lines) if b.kind == "table" else b for b in blocks]


def defined(blocks: list[Block]) -> list[Block]:
    """Paragraphs whose later lines begin with a colon, as a term and its descriptions."""
    out = []
    for b in blocks:
        at = [k for k, (t, _) in enumerate(b.lines) if re.match(r":[ \t]+\S", t)] if b.kind == "paragraph" else []
        if not at or at[0] == 0:
            out.append(b)
            continue
        parts = [b.lines[: at[0]], *(b.lines[i:j] for i, j in zip(at, [*at[1:], len(b.lines)], strict=True))]
        items = []
        for k, lines in enumerate(parts):
            skip = re.match(r":[ \t]+", lines[0][0]).end() if k else 0
            lines = [(lines[0][0][skip:], lines[0][1] + skip), *lines[1:]]
            end = lines[-1][1] + len(lines[-1][0])
            items.append(Block("description" if k else "term", lines[0][1], end, children=[Block("paragraph", lines[0][1], end, lines)]))
        out.append(Block("definitions", b.start, b.end, b.lines, items))
    return out


def prefix_runs(doc: Parsed) -> list[tuple[int, int]]:
    """Ranges from the start of a line to where its content begins inside quotes and items, one a line."""
    ends: dict[int, int] = {}
    for b, _, owner in doc.nodes:
        spots = [a for _, a in b.lines] if owner is not None and not b.children else []
        if b.kind == "quote":
            spots += [a + QUOTE.match(t).end() for t, a in b.lines if QUOTE.match(t)]
        for a in spots:
            start = doc.text.rfind("\n", 0, a) + 1
            if a > start:
                ends[start] = max(a, ends.get(start, 0))
    return sorted(ends.items())


def parse(text: str, options: Options | None = None, facts: bool = True, wanted: set[str] | None = None, marks: str | None = None) -> Parsed:
    """Blocks and inline structure; the fact lists only if they are asked for, all or the ``wanted``.

    With ``marks`` only those runs of ``prose`` are wanted that hold one of these characters.
    """
    options = options or Options()
    text = canonical(text)
    front = front_matter(text)
    lines = split_lines(text[front[0] :], front[0]) if front else split_lines(text)
    blocks = parse_blocks(lines)
    if not options.tables:
        blocks = untabled(blocks)
    if options.definition_lists:
        for b, _, _ in walk(blocks):
            b.children = defined(b.children)
        blocks = defined(blocks)
    out = Parsed(text, blocks, front=front, nodes=walk(blocks))
    if facts:
        if wanted is not None and "wrappable" not in wanted and (marks or "prose" not in wanted):
            out.tells = _tells(marks or "")
        _collect(out, options, wanted, marks)
    return out


def blank_ends(text: str, byte: Callable[[int], int]) -> list[dict]:
    """Blanks at the end of a line of a canonical text; ``n`` is the length of the line. They need no parse."""
    out = []
    for m in _BLANK_END.finditer(text):
        s, e = m.span()
        out.append({"s": byte(s), "e": byte(e), "text": m[0], "n": e - text.rfind("\n", 0, s) - 1})
    return out


def byte_offsets(text: str) -> Callable[[int], int]:
    """The byte offset of a character offset."""
    if text.isascii():
        return lambda i: i
    wide = [m.start() for m in _WIDE.finditer(text)]
    more = [0, *accumulate(len(text[i].encode("utf-8", "surrogatepass")) - 1 for i in wide)]
    return lambda i: i + more[bisect_left(wide, i)]


def _reach(text: str, at: int, directive: str) -> int:
    """Where a directive for what follows it ends: the next line, or the next block and the line after it."""
    if directive == "allow-next-line":
        end = text.find("\n", at)
        return min(len(text), end + 1) if end >= 0 else len(text)
    at = re.compile(r"(?:[ \t]*\n)*").match(text, min(at, len(text))).end()
    end = re.compile(r"\n[ \t]*(?:\n|\Z)").search(text, at)
    return min(len(text), end.start() + 1) if end else len(text)


def _math(doc: Parsed, options: Options, runs: list[tuple[int, int]]) -> tuple[list, list]:
    """Regions and errors of mathematics outside code, HTML and front matter."""
    from glyphlake.parse.math import scan_math

    exclude = [(b.start, b.end) for b, _, _ in doc.nodes if b.kind in ("code", "html")]
    for _, line in doc.inlines:
        exclude += [(line.src(p.start), line.src(p.end - 1) + 1) for p in line.pieces if p.kind in ("code", "html")]
    if doc.front:
        exclude.append((0, doc.front[0]))
    return scan_math(doc.text, sorted(exclude), options.math == "github", runs)


def _collect(doc: Parsed, options: Options, wanted: set[str] | None = None, marks: str | None = None) -> None:
    text = doc.text
    byte = byte_offsets(text)
    facts: dict[str, list[dict]] = {}
    shape = wanted is None or not wanted.isdisjoint(("nodes", "tree", "checkpoints"))
    gaps = wanted is None or "block_gaps" in wanted
    attrs = options.heading_attributes and (wanted is None or "heading_attrs" in wanted)

    def add(table: str, s: int, e: int, **more) -> None:
        if wanted is None or table in wanted:
            more["s"], more["e"] = byte(s), byte(e)
            facts.setdefault(table, []).append(more)

    if doc.front:
        add("frontmatter", 0, doc.front[0], text=text[: doc.front[0]], kind=doc.front[1])
    groups = 0
    numbers: dict[int, int] = {}
    labels: set[str] = set()
    for b, depth, owner in doc.nodes:
        if shape:
            add("nodes", b.start, b.end, kind=b.kind, n=depth)
            numbers[id(b)] = len(numbers)
            add("tree", b.start, b.end, kind=b.kind, n=depth, text=str(numbers[id(b)]), label=str(numbers[id(owner)]) if owner else None)
            if depth == 0:
                add("checkpoints", b.start, b.start, kind=b.kind)
        if b.kind == "heading":
            first, last = (b.lines[0], b.lines[-1]) if b.lines else (("", b.end), ("", b.end))
            add("headings", first[1], last[1] + len(last[0]), text="\n".join(t for t, _ in b.lines), n=b.info["level"], kind="setext" if b.info["setext"] else "atx")
            if attrs and b.lines and (m := re.search(r"\{([^{}]*)\}\s*$", b.lines[-1][0])):
                add("heading_attrs", last[1] + m.start(), last[1] + m.end(1) + 1, text=m[1])
        elif b.kind == "code":
            body = "\n".join(t for t, _ in b.lines)
            head = text[b.start : b.end].split("\n", 1)[0]
            add("code_blocks", b.start, b.end, text=body, kind="fenced" if b.info["fenced"] else "indented", label=b.info["info"], n=len(head.encode()))
        elif b.kind == "html":
            for t, a in b.lines:
                add("html_blocks", a, a + len(t), text=t)
                if m := _DIRECTIVE.match(t):
                    for name in [x for x in re.split(r"[, \t]+", m[2]) if x] or [""]:
                        if name or m[1].endswith("-all"):
                            add("suppressions", a, a + len(t), kind=m[1].removesuffix("-all"), text=name, n=byte(_reach(text, a + len(t) + 1, m[1])))
        elif b.kind == "break":
            add("thematic_breaks", b.start, b.end, text=text[b.start : b.end])
        elif b.kind == "list":
            add("list_groups", b.start, b.end, n=len(b.children), kind="ordered" if b.info["ordered"] else "bullet", text="loose" if b.info["loose"] else "tight", label=str(groups))
            for k, item in enumerate(b.children):
                add("item_widths", item.info["marker_start"], item.info["marker_end"], n=item.info["width"])
                add("list_items", item.info["marker_start"], item.info["marker_end"], n=k, kind="ordered" if b.info["ordered"] else "bullet", text=item.info["marker"], label=str(groups))
            groups += 1
        elif b.kind == "definition":
            add("link_defs", b.start, b.end, text=b.info["label"], label=normal_label(b.info["label"]), kind=b.info["dest"])
            if normal_label(b.info["label"]) not in labels:
                labels.add(normal_label(b.info["label"]))
                add("definition_sites", b.info["dest_start"], b.info["dest_end"], label=normal_label(b.info["label"]), text=text[b.info["dest_start"] : b.info["dest_end"]])
        elif b.kind == "table":
            add("tables", b.start, b.end, n=len(b.info["align"]), text=",".join(b.info["align"]))
            for k, row in enumerate(b.info["rows"]):
                for j, (t, a) in enumerate(row):
                    around = text[max(a - 1, 0) : a].rjust(1) + text[a + len(t) : a + len(t) + 1].ljust(1)
                    add("table_cells", a, a + len(t), n=k, text=t, label=str(j), kind=around)
    for a, b in zip(doc.blocks, doc.blocks[1:], strict=False) if gaps else ():
        add("block_gaps", a.end, b.start, kind=f"{a.kind}>{b.kind}", n=text.count("\n", a.end, b.start) - 1)
    for at in (0, len(text)):
        add("checkpoints", at, at, kind="bookend")
    tex = "\\" in text or options.math == "github" and "$" in text  # else there is no mathematics
    runs = prefix_runs(doc) if wanted is None or "transparent" in wanted or tex else []
    for s, e in runs:
        add("transparent", s, e, text=text[s:e])
    holds = _one_of(marks).search if marks else None
    wrap = wanted is None or "wrappable" in wanted
    owners = {id(b): owner for b, _, owner in doc.nodes} if wrap else {}
    for b, line in doc.inlines:
        if wrap and b.kind == "paragraph" and not ADMONITION.match(b.lines[0][0]):
            head = text[text.rfind("\n", 0, b.lines[0][1]) + 1 : b.lines[0][1]]
            owner = owners.get(id(b))
            add("wrappable", b.lines[0][1], b.lines[-1][1] + len(b.lines[-1][0]), kind=owner.kind if owner else "document", text=continuation(head),
                label=str(sum(p.kind == "hard" for p in line.pieces)), n=sum(p.kind in SOLID for p in line.pieces))
        src = line.src
        for p in sorted(line.pieces, key=lambda p: (p.start, -p.end)) if len(line.pieces) > 1 else line.pieces:
            s, e = src(p.start), src(p.end - 1) + 1 if p.end > p.start else src(p.start)
            if p.kind == "text":
                if holds is None or holds(p.text):
                    add("prose", s, e, text=p.text)
            elif p.kind == "code":
                add("inline_codes", s, e, text=p.text, kind=text[max(s - 1, 0) : s], label=text[e : e + 3])
            elif p.kind == "html":
                add("inline_html", s, e, text=p.text)
            elif p.kind == "autolink":
                add("autolinks", s, e, text=p.text, kind="CommonMark")
                add("link_like", s, e)
            elif p.kind == "gfm":
                if options.autolinks == "urls-and-emails" or (options.autolinks == "urls" and p.extra[0] == "GfmUrl"):
                    add("autolinks", s, e, text=p.text, kind=p.extra[0])
            elif p.kind in ("link", "image"):
                add("links", s, e, text=p.text, kind=p.extra[0], label=p.kind)
                add("link_like", s, e)
                if p.extra[0] == "inline" and p.b > p.a:
                    add("link_dests", src(p.a), src(p.b - 1) + 1, text=line.text[p.a : p.b])
            elif p.kind in ("em", "strong"):
                add("emphasis", s, e, text=p.text, kind=p.kind)
    for b, _, _ in doc.nodes:
        if b.kind == "definition":
            add("link_like", b.start, b.end)
    regions, errors = _math(doc, options, runs) if tex else ([], [])
    for r in regions:
        add("math_regions", r.start, r.end, kind=r.kind, label=r.env or "", text=r.clean(text, runs)[0], n=byte(r.body_start))
    for e in errors:
        add("math_errors", e.start, e.end, kind=e.kind, text=e.name)
    if wanted is not None and "blank_ends" in wanted:
        facts["blank_ends"] = blank_ends(text, byte)
    doc.facts = {k: sorted(v, key=lambda f: (f["s"], f["e"])) if len(v) > 1 else v for k, v in facts.items()}


def continuation(head: str, four_space: bool = False) -> str:
    """What stands before the later lines of a paragraph whose first line has ``head`` before it."""
    if four_space and head.strip(" >"):
        return re.sub(r"[^>\s].*", "    ", head)
    return re.sub(r"[^>\s]", " ", head)


def is_blank_line(text: str) -> bool:
    return blank(text)
