"""Main text of web pages: page structure as a hint, and differencing against the nearest URL of the same host.

Each page is read into blocks of text. Elements whose nature their tag, or a whole class, id or role name, gives away
(navigation, footers, adverts, forms, scripts, comments, ...) are dropped at once. Blocks directly in the page's article
(``article`` or ``main``) are marked as such, which is only a hint; all other blocks are open, those of elements with such
a word in a longer name among them. An article's header stays. Articles are not dropped for their own names, nor is what
holds the page's article: where none is outside dropped elements, the longest one inside, if it is longer than all text outside.

Every page is paired with its nearest URL: within a host, equal pages are merged, the rest sorted by path, and of the two
neighbours the one with the longer common path is taken. The lines of the pair that were not dropped, those of the
article too, are aligned by longest common subsequence, and the shared lines, which are the site's and not the page's, are
deleted. Where ``SAME`` or more of the article's characters are shared, the two are versions of one article, whose lines
stay. A page that would lose all its text (its partner contains it) keeps it.

Sorting is a range partitioning over (host, path, content), so a host of any size is spread over many tasks; neighbours
across partitions are filled in from the two end rows of each.

Defined results: null or empty html gives an empty text; a null URL is host and path "" ; repeated rows are each reported
with the same text; a page alone on its host keeps all that its tags do not drop; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from glyphlake.llm.common import Workspace, map_texts, shuffle_partitions

_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template|svg|math|select|object|canvas|video|audio"
_PIECE = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_HINT = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN_WORDS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "contentinfo", "sidebar",
    "side", "aside", "complementary", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "comment", "comments", "reply", "replies",
    "respond", "disqus", "form", "search", "subscribe", "subscription", "newsletter", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "widget", "pagination", "pager", "toolbar", "skip", "copyright",
}
_DROP_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "input", "head", "option", "datalist"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
          "caption", "figure", "figcaption", "section", "article", "main", "address", "details", "summary", "hgroup", "br", "hr", "body", "html"}
_CLOSES_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "section", "article", "main", "div", "address", "figure", "hr",
             "nav", "header", "footer", "aside", "form", "fieldset", "details", "menu"}
DROPPED, KEPT, OPEN = 0, 1, 2
SAME = 0.9


def _hints(attrs: str) -> tuple[bool, bool]:
    """Whether a whole name is a word of hidden elements, and whether a part of a name is."""
    found = " ".join(a or b or c for a, b, c in _HINT.findall(attrs)) if attrs else ""
    if not found:
        return False, False
    parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())
    return not _HIDDEN_WORDS.isdisjoint(found.lower().split()), not _HIDDEN_WORDS.isdisjoint(parts)


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, DROPPED/KEPT/OPEN) of each block of a page in order; white space is collapsed, references are decoded."""
    out, hidden, around = _read(page, frozenset())
    seen: dict[int, int] = {}
    for (text, _), k in zip(out, hidden, strict=True):
        if k:
            seen[k] = seen.get(k, 0) + len(text)
    if seen and all(s != KEPT for _, s in out):
        best = max(seen, key=lambda k: (seen[k], -k))
        if seen[best] > sum(len(t) for t, s in out if s != DROPPED):
            out, _, _ = _read(page, around[best])
    return out


def _read(page: str | None, spared: frozenset[int]) -> tuple[list[tuple[str, int]], list[int], dict[int, frozenset[int]]]:
    """Blocks; for each the number of the article around it inside a dropped element (0: none); for each such article the
    numbers of the elements around it. Elements in ``spared`` are not dropped."""
    out: list[tuple[str, int]] = []
    hidden: list[int] = []
    around: dict[int, frozenset[int]] = {}
    if not page:
        return out, hidden, around
    stack: list[tuple[str, int, bool, int, int]] = []  # tag, number; before it: state, inside an article, article inside a dropped element
    state, inside, within, number = OPEN, False, 0, 0
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, state))
                hidden.append(within)
            text.clear()

    for m in _PIECE.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] or m[0].startswith("<![CDATA["):
                pass
            continue
        if tag in _INLINE:
            if not (m[4] and not m[2] and any(_hints(m[4]))) and not (stack and stack[-1][0] == tag):
                continue
            if tag in _VOID:
                continue
        flush()
        if tag in _VOID:
            continue
        if m[2]:
            if any(t == tag for t, *_ in stack):
                while stack:
                    t, state, inside, within, _ = stack.pop()
                    if t == tag:
                        break
            continue
        if m[4].rstrip().endswith("/") and tag not in _PLAIN and tag != "div":
            continue
        if tag in _CLOSES_P and stack and stack[-1][0] == "p":
            _, state, inside, within, _ = stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            _, state, inside, within, _ = stack.pop()
        number += 1
        stack.append((tag, state, inside, within, number))
        if state == DROPPED:
            if tag in ("article", "main") and not within:
                within = number
                around[number] = frozenset(x[4] for x in stack)
            continue
        whole, part = _hints(m[4]) if tag not in ("html", "body") else (False, False)
        if tag in ("article", "main"):
            state, inside = (OPEN if whole and not inside else KEPT), True
        elif number in spared:
            state = OPEN
        elif tag == "header" and inside:
            state = OPEN if part else state
        elif tag in _DROP_TAGS or whole:
            state = DROPPED
        elif part or (inside and tag not in _PLAIN and not (tag == "div" and state == KEPT and not m[4].strip())):
            state = OPEN
    if at < len(page):
        text.append(page[at:])
    flush()
    return out, hidden, around


def split_url(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence of a and b; rows of the table are bit vectors."""
    if not a or not b:
        return set()
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for line in a:
        m = masks.get(line, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    picked, j = set(), len(b)
    for i in range(len(a), 0, -1):
        if j == 0:
            break

        def length(row: int, upto: int) -> int:
            return upto - (rows[row] & ((1 << upto) - 1)).bit_count()

        while j and length(i, j) == length(i, j - 1):
            j -= 1
        if j and length(i, j) != length(i - 1, j):
            picked.add(i - 1)
            j -= 1
    return picked


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def without_shared(lines: list[str], states: list[int], partner: list, names: list | None = None) -> str:
    """The lines that are not dropped, less those that the partner page shares; ``partner`` holds its lines or, with ``names``
    of these lines, its names."""
    alive = [k for k, s in enumerate(states) if s != DROPPED]
    gone = {alive[k] for k in common_lines([(names or lines)[k] for k in alive], partner)}
    article = sum(len(lines[k]) for k in alive if states[k] == KEPT)
    if article and sum(len(lines[k]) for k in gone if states[k] == KEPT) >= SAME * article:
        gone = {k for k in gone if states[k] == OPEN}
    return " ".join([lines[k] for k in alive if k not in gone] or [lines[k] for k in alive])


def _neighbours(keys: DataFrame, ws: Workspace) -> DataFrame:
    """``(host, path, content)`` -> with ``partner``, the content of the nearest URL of the host (null: none)."""
    n = shuffle_partitions(keys.sparkSession)
    ordered = keys.repartitionByRange(n, "host", "path", "content").sortWithinPartitions("host", "path", "content")
    names = ["host", "path", "content", "part", "row", "before", "after"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, row = TaskContext.get().partitionId(), None, 0
        last = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for host, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                me = f"{host}\n{path}\n{content}"
                if held is not None:
                    rows.append((*held[:5], last, me))
                    last = f"{held[0]}\n{held[1]}\n{held[2]}"
                held = (host, path, content, part, row)
                row += 1
            if rows:
                yield emit(rows)
        if held is not None:
            yield emit([(*held, last, None)])

    walked = ws.save(ordered.mapInArrow(walk, "host string, path string, content string, part int, row long, before string, after string"), "order")
    me = F.concat_ws("\n", "host", "path", "content")
    line = W.orderBy("part", "row")
    ends = walked.where("before is null or after is null")  # two rows a partition
    ends = ends.withColumn("before", F.coalesce("before", F.lag(me).over(line))).withColumn("after", F.coalesce("after", F.lead(me).over(line)))
    whole = walked.where("before is not null and after is not null").unionByName(ends)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path, content, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = (-1, None)
                for other in (before, after):
                    h, p, c = other.split("\n") if other is not None else (None, "", None)
                    if h == host and c != content and _shared_prefix(path, p) > best[0]:
                        best = (_shared_prefix(path, p), c)
                out.append(best[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, type=pa.string())], names=["host", "path", "content", "partner"])

    return whole.select("host", "path", "content", "before", "after").mapInArrow(nearest, "host string, path string, content string, partner string")


def _names(lines: list[str]) -> bytes:
    """A name of 12 bytes for each line."""
    return b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=12).digest() for t in lines)


def _split_names(names: bytes | None) -> list[bytes]:
    return [names[k : k + 12] for k in range(0, len(names or b""), 12)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Pages are read twice: first for the names of their lines, which are all that pairing and alignment need, then for their
    lines, which are moved once, compressed, to the names of the partner.
    """
    ws = Workspace(pages.sparkSession, "htmltext")

    def alive(page: str | None) -> tuple[list[str], list[int], str]:
        found = [(t, s) for t, s in blocks_of(page) if s != DROPPED]
        content = hashlib.sha256("\n".join(f"{s}{t}" for t, s in found).encode("utf-8", "surrogatepass")).hexdigest()
        return [t for t, _ in found], [s for _, s in found], content

    def named(page: str | None) -> tuple:
        lines, _, content = alive(page)
        return content, _names(lines)

    def packed(page: str | None) -> tuple:
        lines, states, content = alive(page)
        return content, zlib.compress("\n".join(f"{s}{t}" for t, s in zip(lines, states, strict=True)).encode("utf-8", "surrogatepass"))

    def place(url: str | None) -> tuple:
        return tuple(x.replace("\n", " ") for x in split_url(url))

    def placed(rows: DataFrame) -> DataFrame:
        return map_texts(rows.withColumn("link", F.col("url")), "link", {c: c for c in rows.columns}, "host string, path string", place)

    keys = map_texts(pages, html_col, {"url": url_col}, "content string, names binary", named).where("length(names) > 0")
    keys = placed(keys).groupBy("host", "content").agg(F.min("path").alias("path"), F.first("names").alias("names"))
    keys = ws.save(keys, "keys")
    pairs = ws.save(_neighbours(keys.select("host", "path", "content"), ws), "pairs").where("partner is not null")
    partners = pairs.select("host", F.col("content").alias("k"), F.col("partner").alias("content")).join(keys.select("host", "content", "names"), ["host", "content"])
    partners = partners.select(F.col("host").alias("h"), "k", "names")
    rows = placed(map_texts(pages, html_col, {"id": id_col, "url": url_col}, "content string, packed binary", packed)).drop("path")
    joined = rows.join(partners, (F.col("host") == F.col("h")) & (F.col("content") == F.col("k")), "left").select("id", "url", "packed", "names")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, names in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                found = zlib.decompress(data).decode("utf-8", "surrogatepass")
                lines, states = ([x[1:] for x in found.split("\n")], [int(x[0]) for x in found.split("\n")]) if found else ([], [])
                texts.append(without_shared(lines, states, _split_names(names), _split_names(_names(lines))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())], names=["id", "url", "text"])

    out = joined.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
