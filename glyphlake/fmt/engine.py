"""The formatter of one document, and its Spark form.

A family proposes edits from the facts of a parse. All edits of a family are tried at once; if the signature of the result
differs, they are tried one by one and only those that keep it stay. Families run in a fixed order until nothing changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from glyphlake.functions.text import width_of
from glyphlake.operators.batches import slices
from glyphlake.parse.blocks import Block
from glyphlake.parse.facts import ADMONITION, SOLID, Parsed, canonical, continuation, parse
from glyphlake.sources.config import Fmt

Edit = tuple[int, int, str]
MOST_STEPS, MOST_TOKENS = 64, 100_000


@dataclass
class Report:
    proposed: int = 0
    applied: int = 0
    rejected: int = 0
    families: dict[str, int] = field(default_factory=dict)
    converged: bool = True


def read(text: str) -> Parsed:
    return parse(text, facts=False)


def outline(doc: Parsed) -> list[tuple]:
    """The blocks of a signature without what is written in them: where it differs, so does the signature."""
    out: list[tuple] = []
    for b, depth, _ in doc.nodes:
        if b.kind == "list":
            out.append((depth, "list", b.info["ordered"], b.info["loose"]))
        else:
            out.append((depth, b.kind))
    return out


def signature(source: str | Parsed, keep_front: bool = True) -> list[tuple]:
    """What a document says: blocks and inline structure with white space collapsed; code as it is."""
    doc = read(source) if isinstance(source, str) else source
    out: list[tuple] = [("front", doc.text[: doc.front[0]])] if doc.front and keep_front else []
    inline = {}
    for b, line in doc.inlines:
        inline.setdefault(id(b), []).append(line)

    def pieces(b: Block) -> Iterator[tuple]:
        for line in inline.get(id(b), []):
            words: list[str] = []
            for p in sorted(line.pieces, key=lambda p: (p.start, -p.end)):
                if p.kind == "text":
                    words.append(p.text)
                elif p.kind == "break":
                    words.append(" ")
                elif p.kind in ("em", "strong", "strike"):
                    words.append(f"\0{p.kind}{line.text[p.a : p.b].count(' ')}\0")
                elif p.kind in ("link", "image"):
                    words.append(f"\0{p.kind}{line.text[p.a : p.b].strip('<>')}\0")
                elif p.kind != "gfm":
                    words.append(f"\0{p.kind}{' '.join(p.text.split())}\0")
            said = " ".join("".join(words).split())
            if b.kind == "heading" and (m := re.search(r"\s*\{([^{}]*)\}$", said)):
                parts = m[1].split()
                named = tuple([x for x in parts if x[0] == "#"][-1:]), tuple(x for x in parts if x[0] == "."), tuple(x for x in parts if x[0] not in "#.")
                said = said[: m.start()]
                yield ("attributes", *named)
            yield ("inline", said)

    for b, depth, _ in doc.nodes:
        if b.kind == "code":
            out.append((depth, "code", b.info["info"], "\n".join(t for t, _ in b.lines)))
        elif b.kind == "html":
            out.append((depth, "html", "\n".join(t for t, _ in b.lines)))
        elif b.kind == "definition":
            out.append((depth, "definition", b.info["label"], b.info["dest"], b.info["title"]))
        elif b.kind == "table":
            out.append((depth, "table", tuple(b.info["align"]), tuple(tuple(" ".join(t.split()) for t, _ in row) for k, row in enumerate(b.info["rows"]) if k != 1)))
        elif b.kind == "list":
            out.append((depth, "list", b.info["ordered"], b.info["loose"], b.info["first"] if b.info["ordered"] else 0))
        else:
            out.append((depth, b.kind, b.info.get("level")))
            out += pieces(b)
    return out


def splice(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for s, e, new in sorted(edits):
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def disjoint(edits: list[Edit]) -> bool:
    rows = sorted(edits)
    return all(a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False))


_MARKS = {"dash": "-", "asterisk": "*", "plus": "+", "underscore": "_"}


def italic(doc: Parsed, o: Fmt, kind: str = "em") -> list[Edit]:
    want = {"asterisk": "*", "underscore": "_"}.get(o.italic if kind == "em" else o.strong)
    out: list[Edit] = []
    for _, line in doc.inlines if want else ():
        for p in line.pieces:
            if p.kind == kind and p.text != want:
                n = 1 if kind == "em" else 2
                a, b = line.src(p.start), line.src(p.end - n)
                out += [(a, a + n, want * n), (b, b + n, want * n)]
    return out


def list_marker(doc: Parsed, o: Fmt) -> list[Edit]:
    want = _MARKS.get(o.list_marker)
    return [(i.info["marker_start"], i.info["marker_end"], want) for b, _, _ in (doc.nodes if want else ()) if b.kind == "list" and not b.info["ordered"] for i in b.children if i.info["marker"] != want]


def ordered_list(doc: Parsed, o: Fmt) -> list[Edit]:
    out: list[Edit] = []
    for b, _, _ in doc.nodes if o.ordered_list != "preserve" else ():
        if b.kind == "list" and b.info["ordered"]:
            for k, i in enumerate(b.children):
                n = b.info["first"] + (k if o.ordered_list == "consistent" else 0)
                new = f"{n}{i.info['marker'][-1]}"
                if new != i.info["marker"]:
                    out.append((i.info["marker_start"], i.info["marker_end"], new))
    return out


def thematic_break(doc: Parsed, o: Fmt) -> list[Edit]:
    if o.thematic_break == "preserve":
        return []
    out: list[Edit] = []
    for b, _, _ in doc.nodes:
        if b.kind == "break":
            old = doc.text[b.start : b.end]
            new = "_" * 70 if o.thematic_break == "underscore-70" else re.sub(r"[-*_]", _MARKS[o.thematic_break], old)
            if new != old:
                out.append((b.start, b.end, new))
    return out


def references(doc: Parsed, o: Fmt) -> list[Edit]:
    if o.refs_style not in ("angle", "bare"):
        return []
    spots = [(b.info["dest_start"], b.info["dest_end"]) for b, _, _ in doc.nodes if b.kind == "definition"]
    spots += [(line.src(p.a), line.src(p.b - 1) + 1) for _, line in doc.inlines for p in line.pieces if p.kind == "link" and p.b > p.a]
    out: list[Edit] = []
    for s, e in spots:
        body = doc.text[s:e]
        if o.refs_style == "angle" and not body.startswith("<"):
            out.append((s, e, f"<{body}>"))
        elif o.refs_style == "bare" and body.startswith("<") and re.fullmatch(r"[^\s<>()\\]+", body[1:-1]):
            out.append((s, e, body[1:-1]))
    return out


def heading_attrs(doc: Parsed, o: Fmt) -> list[Edit]:
    out: list[Edit] = []
    for b, _, _ in doc.nodes if o.heading_attrs == "canonicalise" else ():
        if b.kind == "heading" and b.lines and (m := re.search(r"\{([^{}]*)\}\s*$", b.lines[-1][0])):
            parts = m[1].split()
            ids, classes = [p for p in parts if p.startswith("#")], [p for p in parts if p.startswith(".")]
            new = "{" + " ".join([*ids[-1:], *classes, *(p for p in parts if p[0] not in "#.")]) + "}"
            at = b.lines[-1][1] + m.start()
            if new != doc.text[at : at + len(m[0].rstrip())]:
                out.append((at, at + len(m[0].rstrip()), new))
    return out


def _rule(align: str, n: int = 3) -> str:
    return {"left": ":" + "-" * (n - 1), "right": "-" * (n - 1) + ":", "center": ":" + "-" * (n - 2) + ":"}.get(align, "-" * n)


def tables(doc: Parsed, o: Fmt) -> list[Edit]:
    out: list[Edit] = []
    for b, _, _ in doc.nodes if o.tables_style != "preserve" else ():
        if b.kind != "table":
            continue
        align, rows = b.info["align"], [[t for t, _ in row] for row in b.info["rows"]]
        rows = [row[: len(align)] + [""] * (len(align) - len(row)) for row in rows]
        wide = [max([3, *(width_of(r[k]) or 0 for j, r in enumerate(rows) if j != 1)]) for k in range(len(align))]
        for j, ((text, at), row) in enumerate(zip(b.lines, rows, strict=True)):
            if o.tables_style == "compact":
                cells = [_rule(a) for a in align] if j == 1 else row
            elif j == 1:
                cells = [_rule(a, w) for a, w in zip(align, wide, strict=True)]
            else:
                cells = []
                for t, a, w in zip(row, align, wide, strict=True):
                    gap = w - (width_of(t) or 0)
                    left = gap if a == "right" else gap // 2 if a == "center" else 0
                    cells.append(" " * left + t + " " * (gap - left))
            new = "| " + " | ".join(cells) + " |"
            lead = len(text) - len(text.lstrip(" "))
            if text[lead:].rstrip() != new:
                out.append((at + lead, at + len(text), new))
    return out


def excluded_from_math(doc: Parsed) -> list[tuple[int, int]]:
    skip = [(b.start, b.end) for b, _, _ in doc.nodes if b.kind in ("code", "html")]
    skip += [(line.src(p.start), line.src(p.end - 1) + 1) for _, line in doc.inlines for p in line.pieces if p.kind in ("code", "html")]
    return sorted(skip)


def math_render(doc: Parsed, o: Fmt) -> list[Edit]:
    from glyphlake.parse.math import scan_math

    if o.math_render != "dollar":
        return []
    regions, _ = scan_math(doc.text, excluded_from_math(doc))
    out: list[Edit] = []
    for r in regions:
        body = doc.text[r.body_start : r.body_end].strip()
        if r.kind == "inline":
            out.append((r.start, r.end, f"${body}$"))
        elif r.kind == "display":
            out.append((r.start, r.end, f"$$ {body} $$"))
    return out


def aligned_rows(body: str) -> str:
    """Rows of an aligning environment with their cells padded to common widths."""
    rows = [[c.strip() for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\", body.strip("\n"))]
    n = max(map(len, rows))
    wide = [max((width_of(r[k]) or 0 for r in rows if k < len(r)), default=0) for k in range(n)]
    return "\n" + " \\\\\n".join(" & ".join(c + " " * (wide[k] - (width_of(c) or 0)) for k, c in enumerate(r)).rstrip() for r in rows) + "\n"


def math_normalise(doc: Parsed, o: Fmt) -> list[Edit]:
    from glyphlake.parse.math import ALIGNING, scan_math

    if not o.math_normalise:
        return []
    regions, _ = scan_math(doc.text, excluded_from_math(doc))
    out: list[Edit] = []
    for r in regions:
        if r.env in ALIGNING:
            new = aligned_rows(doc.text[r.body_start : r.body_end])
            if new != doc.text[r.body_start : r.body_end]:
                out.append((r.body_start, r.body_end, new))
    return out


def frontmatter(doc: Parsed, o: Fmt) -> list[Edit]:
    if o.frontmatter_preserve or not doc.front:
        return []
    e = doc.front[0]
    while e < len(doc.text) and doc.text[e] == "\n":
        e += 1
    return [(0, e, "")]


def heading_gaps(doc: Parsed, o: Fmt) -> list[Edit]:
    out: list[Edit] = []
    if "one" not in (o.blank_line_before_heading, o.blank_line_after_heading):
        return out
    for a, b in zip(doc.blocks, doc.blocks[1:], strict=False):
        before, after = b.kind == "heading" and o.blank_line_before_heading == "one", a.kind == "heading" and o.blank_line_after_heading == "one"
        gap = doc.text[a.end : b.start]
        if (before or after) and not gap.strip() and gap != "\n\n":
            out.append((a.end, b.start, "\n\n"))
    return out


FAMILIES: dict[str, Callable[[Parsed, Fmt], list[Edit]]] = {
    "frontmatter": frontmatter, "italic": italic, "strong": lambda d, o: italic(d, o, "strong"), "list-marker": list_marker, "ordered-list": ordered_list,
    "thematic-break": thematic_break, "references": references, "heading-attrs": heading_attrs, "tables": tables, "math-normalise": math_normalise, "math-render": math_render,
    "heading-gaps": heading_gaps,
}


def fill(words: list[str], width: int, first: int, later: int, strategy: str) -> list[list[str]]:
    """Words in lines: as many as fit, or with the least sum of squared slack (the last line is free)."""
    sizes = [width_of(w) or 0 for w in words]
    if strategy != "balanced" or len(words) > MOST_TOKENS:
        lines, room = [[]], width - first
        for w, n in zip(words, sizes, strict=True):
            if lines[-1] and room < n + 1:
                lines.append([])
                room = width - later
            room -= n + (1 if lines[-1] else 0)
            lines[-1].append(w)
        return lines
    best, back = [0.0] + [float("inf")] * len(words), [0] * (len(words) + 1)
    for j in range(1, len(words) + 1):
        total = -1
        for i in range(j - 1, -1, -1):
            total += sizes[i] + 1
            slack = width - (first if i == 0 else later) - total
            if slack < 0 and i < j - 1:
                break
            cost = best[i] + (0 if j == len(words) and slack >= 0 else float(slack * slack) if slack >= 0 else 1e6)
            if cost < best[j]:
                best[j], back[j] = cost, i
    cuts, j = [], len(words)
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return [words[a:b] for a, b in reversed(cuts)]


def tokens(text: str, solid: list[tuple[int, int]]) -> list[str]:
    """What wrapping may move: words, and solid ranges in one piece with all that touches them. Canonical text holds no NUL."""
    for s, e in solid:
        text = text[:s] + re.sub(r"[ \t\n]", "\0", text[s:e]) + text[e:]
    return [w.replace("\0", " ") for w in re.split(r"[ \t\n]+", text) if w]


@F.pandas_udf(ArrayType(StringType()))
def filled(text: pd.Series, width: pd.Series, strategy: pd.Series) -> pd.Series:
    """The words of a text as lines of at most ``width``."""
    return pd.Series([None if t is None else [" ".join(x) for x in fill(t.split(), int(w), 0, 0, s)] for t, w, s in zip(text, width, strategy, strict=True)])


def wrap(doc: Parsed, o: Fmt) -> list[Edit]:
    """Top-level paragraphs, and those in quotes and items by their own prefix; code and links are not broken."""
    if o.wrap == "keep":
        return []
    out: list[Edit] = []
    for b, line in doc.inlines:
        if b.kind != "paragraph" or ADMONITION.match(b.lines[0][0]):
            continue
        start = doc.text.rfind("\n", 0, b.lines[0][1]) + 1
        head = doc.text[start : b.lines[0][1]]
        later = continuation(head, o.continuation_indent == "four-space")
        hard = [p.end for p in line.pieces if p.kind == "hard"]
        solid = [(p.start, p.end) for p in line.pieces if p.kind in SOLID]
        parts, at = [], 0
        for e in [*hard, len(line.text)]:
            parts.append((at, e))
            at = e
        rows: list[str] = []
        for a, e in parts:
            words = tokens(line.text[a:e], [(x - a, y - a) for x, y in solid if a <= x and y <= e])
            if not words:
                continue
            tail = "" if e == len(line.text) else "\\" if line.text[e - 2] == "\\" else "  "
            words[-1] = words[-1].removesuffix("\\") if tail == "\\" else words[-1]
            lines = [words] if o.wrap == "no" else fill(words, int(o.wrap), len(head) if not rows else len(later), len(later), o.wrap_strategy)
            rows += [" ".join(w) for w in lines]
            rows[-1] += tail
        new = ("\n" + later).join(rows)
        last = b.lines[-1]
        if new != doc.text[b.lines[0][1] : last[1] + len(last[0])]:
            out.append((b.lines[0][1], last[1] + len(last[0]), new))
    return out


def _commit(text: str, edits: list[Edit], check: Callable[[str], bool], report: Report, salvage: bool = True, halve: bool = False, refused: set[str] | None = None) -> str:
    """The text with all edits if that passes the check; else with those that pass one by one.

    Edits that do not depend on each other, such as those of wrapping, are sought by halving. ``refused`` holds whole texts
    that failed the same check before.
    """
    edits = [e for e in dict.fromkeys(edits) if text[e[0] : e[1]] != e[2]]
    report.proposed += len(edits)
    if not edits or not disjoint(edits):
        report.rejected += len(edits)
        return text
    whole, kept = splice(text, edits), []
    if not (refused and whole in refused) and check(whole):
        report.applied += len(edits)
        return whole
    if refused is not None:
        refused.add(whole)

    def parts(part: list[Edit]) -> list[list[Edit]]:
        at = max(len(part) // 2, 1) if halve else 1
        return [part[k : k + at] for k in range(0, len(part), at)] if len(part) > 1 else []

    waiting = parts(edits)[::-1] if salvage else []
    while waiting:
        part = waiting.pop()
        if check(splice(text, [*kept, *part])):
            kept.extend(part)
        else:
            waiting += parts(part)[::-1]
    report.applied += len(kept)
    report.rejected += len(edits) - len(kept)
    return splice(text, kept)


PROFILES = {
    "preserve": {},
    "mdformat": {"list_marker": "dash", "ordered_list": "one", "thematic_break": "underscore-70", "italic": "asterisk", "strong": "asterisk", "trailing_newline": "ensure"},
}


def resolved_options(o: Fmt) -> Fmt:
    """The options with those of their profile filled in where they are left as they are."""
    default = Fmt()
    filled_in = {k: v for k, v in PROFILES[o.profile].items() if getattr(o, k) == getattr(default, k)}
    return Fmt(**{**o.__dict__, "profile": "preserve", **filled_in})


def line_ends(text: str, o: Fmt, crlf: bool) -> str:
    if o.trailing_newline != "preserve" and text:
        text = text.rstrip("\n") + ("\n" if o.trailing_newline == "ensure" else "")
    return text.replace("\n", "\r\n") if o.end_of_line == "crlf" or (o.end_of_line == "keep" and crlf) else text


def _front_only(old: Parsed, new: str) -> bool:
    """Whether a text is the old one without its front matter."""
    return signature(old, False) == signature(new, False) and old.text.endswith(new)


def _same_math(old: Parsed, new: str) -> bool:
    """Whether mathematics has kept its bodies, up to delimiters and blanks, and nothing else has changed."""
    from glyphlake.parse.math import scan_math

    def shape(doc: Parsed) -> tuple[list[str], str]:
        regions, _ = scan_math(doc.text, excluded_from_math(doc), dollars=True)
        rest, at = [], 0
        for r in regions:
            rest.append(doc.text[at : r.start])
            at = r.end
        return ["".join(doc.text[r.body_start : r.body_end].split()) for r in regions], "".join([*rest, doc.text[at:]])

    return shape(old) == shape(read(new))


def format_text(text: str, o: Fmt | None = None) -> tuple[str, Report]:
    o, report = resolved_options(o or Fmt()), Report()
    crlf, source = "\r\n" in text, canonical(text)
    doc, meaning = read(source), None
    passed: list[Parsed] = []  # the last text that kept its meaning; mostly the one that is taken
    refused: set[str] = set()

    def keeps(text: str) -> bool:
        new = read(text)
        if outline(new) != outline(doc) or signature(new) != meaning:
            return False
        passed[:] = [new]
        return True

    for _ in range(MOST_STEPS):
        before = doc.text
        for name, family in FAMILIES.items():
            edits = family(doc, o)
            if not edits:
                continue
            if name == "frontmatter":
                check = lambda t, old=doc: _front_only(old, t)
            elif name in ("math-render", "math-normalise"):
                check = lambda t, old=doc: _same_math(old, t)
            else:
                meaning, check = meaning or signature(doc), keeps
            new = _commit(doc.text, edits, check, report, salvage=name != "ordered-list", refused=refused if check is keeps else None)
            report.families[name] = report.families.get(name, 0) + (new != doc.text)
            if new != doc.text:
                doc = passed[0] if passed and passed[0].text == new else read(new)
                if check is not keeps:
                    meaning = None
                    refused.clear()
        if doc.text == before:
            break
    else:
        report.converged, doc = False, read(source)
    out = doc.text
    if o.wrap != "keep" and (edits := wrap(doc, o)):
        want = meaning or signature(doc)
        out = _commit(out, edits, lambda t: signature(t) == want, report, halve=True)
    return line_ends(out, o, crlf), report


def format_range(text: str, start: int, end: int, o: Fmt | None = None) -> tuple[int, int, str]:
    """The top-level blocks that a range touches, formatted: (start, end, new text) in characters."""
    text = canonical(text)
    blocks = read(text).blocks
    inside = [b for b in blocks if b.start < max(end, start + 1) and start < b.end + 1]
    if not inside:
        return start, start, ""
    s, e = inside[0].start, inside[-1].end
    s = text.rfind("\n", 0, s) + 1
    return s, e, format_text(text[s:e], o)[0]


def stable(text: str, o: Fmt | None = None) -> bool:
    """Whether formatting keeps the source's meaning, and a second pass changes nothing."""
    once = format_text(text, o)[0]
    return signature(once, False) == signature(text, False) and format_text(once, o)[0] == once


def divergence(a: str, b: str) -> tuple[int, str, str] | None:
    """Number and content of the first element in which two documents' meanings differ."""
    x, y = signature(a), signature(b)
    for k in range(max(len(x), len(y))):
        left, right = (x[k] if k < len(x) else None), (y[k] if k < len(y) else None)
        if left != right:
            return k, repr(left), repr(right)
    return None


def plan(edits: DataFrame) -> DataFrame:
    """Edits (doc_id, family, s, e, replacement) in order; a family of which two overlap is left out as a whole."""
    from glyphlake.operators.ranges import drop_overlapping_families

    return drop_overlapping_families(edits).orderBy("doc_id", "s", "e")


def candidates(docs: DataFrame, o: Fmt, families: list[str] | None = None) -> DataFrame:
    """(doc_id, family, s, e, replacement): what each family proposes for a document as it stands; bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    doc = read(canonical(text or ""))
                    rows += [(doc_id, n, len(doc.text[:s].encode()), len(doc.text[:e].encode()), new) for n in families or FAMILIES for s, e, new in FAMILIES[n](doc, o)]
                except (RecursionError, ValueError, IndexError):
                    continue
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "family", "s", "e", "replacement"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, family string, s int, e int, replacement string")


#: The kinds of block in whose bounds a family may edit.
OWNERS = {"italic": ("paragraph", "heading", "table"), "strong": ("paragraph", "heading", "table"), "list-marker": ("list",), "ordered-list": ("list",), "thematic-break": ("break",), "references": ("definition", "paragraph"), "heading-attrs": ("heading",), "tables": ("table",)}


def owned(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edits that lie in a block of a kind their family may edit; families without an owner pass."""
    pairs = edits.sparkSession.createDataFrame([(f, k) for f, kinds in OWNERS.items() for k in kinds], "_family string, _kind string")
    n = nodes.select(F.col("doc_id").alias("_d"), F.col("kind").alias("_kind"), F.col("s").alias("_s"), F.col("e").alias("_e")).join(F.broadcast(pairs), "_kind")
    test = (F.col("doc_id") == F.col("_d")) & (F.col("family") == F.col("_family")) & (F.col("_s") <= F.col("s")) & (F.col("e") <= F.col("_e"))
    bound = F.col("family").isin(list(OWNERS))
    return edits.where(bound).join(n, test, "left_semi").unionByName(edits.where(~bound))


def text_function(function: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A function of one text as a column; null stays null."""

    def call(x: Column, *more: Column) -> Column:
        @F.arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            return pa.array([None if r[0] is None else function(*r) for r in rows], type=_ARROW[kind])

        return run(x, *more)

    return call


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
meaning = text_function(lambda t: [repr(x) for x in signature(t)], "array<string>")
same_meaning = text_function(lambda a, b: signature(a) == signature(b or ""), "boolean")

_SCHEMA = "doc_id long, formatted string, changed boolean, proposed int, applied int, rejected int, converged boolean, stable boolean"


def formatted(docs: DataFrame, o: Fmt | None = None, check: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> formatted text and report of each; documents are independent, so there is no shuffle."""
    options = o or Fmt()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    new, r = format_text(text or "", options)
                    rows.append((new, new != (text or ""), r.proposed, r.applied, r.rejected, r.converged, stable(text or "", options) if check else None))
                except (RecursionError, ValueError, IndexError):
                    rows.append((text, False, 0, 0, 0, False, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "formatted", "changed", "proposed", "applied", "rejected", "converged", "stable"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def explanation(rows: DataFrame) -> DataFrame:
    """(doc_id, note): a line on what was proposed, applied and rejected where anything was."""
    some = rows.where("proposed > 0 or not converged")
    note = F.concat(F.col("proposed").cast("string"), F.lit(" proposed, "), F.col("applied").cast("string"), F.lit(" applied, "), F.col("rejected").cast("string"), F.lit(" rejected"))
    return some.select("doc_id", F.when(~F.col("converged"), F.concat(F.lit("not settled, kept as it was: "), note)).otherwise(note).alias("note"))


def format_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("changed").alias("n_changed"), F.sum("proposed").alias("n_proposed"), F.sum("applied").alias("n_applied"),
                    F.sum("rejected").alias("n_rejected"), F.count_if(~F.col("converged")).alias("n_not_converged"))


def salvaged(text: str, o: Fmt, family: str) -> tuple[int, int, int]:
    """Edits proposed, applied and rejected in one commit of one family."""
    doc, report = read(canonical(text)), Report()
    want = signature(doc)
    _commit(doc.text, FAMILIES[family](doc, o), lambda t: signature(t) == want, report)
    return report.proposed, report.applied, report.rejected
