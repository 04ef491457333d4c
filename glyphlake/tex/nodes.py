"""TeX bodies as trees: tokens and nodes with spans, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphlake.tex import registry as R
from glyphlake.tex.translate import Token, lex

FRACTIONS = ("frac", "dfrac", "tfrac", "binom")
TEXTS = ("text", "mbox", "textrm", "textbf", "textit", "mathrm", "mathit", "operatorname")


@dataclass
class Node:
    kind: str  # body, group, atom, symbol, text, fraction, root, accent, script, delimited, environment, row, cell
    start: int
    end: int
    text: str = ""
    parts: list[Node] = field(default_factory=list)


class Malformed(ValueError):
    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.start, self.end = start, end


class TreeParser:
    """Recursive descent; strict: what is unclosed, unmatched or unknown raises ``Malformed``."""

    def __init__(self, body: str):
        self.body, self.tokens, self.at = body, lex(body), 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def fail(self, message: str, t: Token | None = None) -> Malformed:
        n = len(self.body)
        return Malformed(message, t.start if t else n, t.end if t else n)

    def blanks(self) -> None:
        while (t := self.peek()) and t.kind == "space":
            self.at += 1

    def whole(self) -> Node:
        return Node("body", 0, len(self.body), parts=self.run(()))

    def run(self, stops: tuple[str, ...]) -> list[Node]:
        out = []
        while t := self.peek():
            if t.kind in stops or (t.kind == "command" and t.text in stops):
                break
            if t.kind == "space":
                self.at += 1
                continue
            out.append(self.scripted())
        return out

    def argument(self) -> Node:
        self.blanks()
        t = self.peek()
        if t is None:
            raise self.fail("an argument is missing")
        return self.one()

    def scripted(self) -> Node:
        t = self.peek()
        base = Node("group", t.start, t.start) if t.kind in ("super", "sub") else self.one()
        marks = {}
        while (t := self.peek()) and t.kind in ("super", "sub"):
            if t.kind in marks:
                raise self.fail(f"second {t.kind}script", t)
            self.at += 1
            marks[t.kind] = self.argument()
        if not marks:
            return base
        return Node("script", base.start, max(m.end for m in marks.values()), " ".join(sorted(marks)), [base, *(marks[k] for k in sorted(marks))])

    def one(self) -> Node:
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "open":
            parts = self.run(("close",))
            if (end := self.peek()) is None:
                raise self.fail("unclosed group", t)
            self.at += 1
            return Node("group", t.start, end.end, parts=parts)
        if t.kind != "command":
            if t.kind in ("close", "cell", "row"):
                raise self.fail({"close": "unmatched brace"}.get(t.kind, "a cell outside an environment"), t)
            return Node("atom", t.start, t.end, t.text)
        name = t.text
        if name in FRACTIONS:
            parts = [self.argument(), self.argument()]
            return Node("fraction", t.start, parts[1].end, name, parts)
        if name == "sqrt":
            degree = []
            if (n := self.peek()) and n.text == "[":
                self.at += 1
                while (n := self.peek()) and n.text != "]":
                    degree.append(self.scripted())
                if n is None:
                    raise self.fail("unclosed degree", t)
                self.at += 1
            inner = self.argument()
            return Node("root", t.start, inner.end, "", [inner, *([Node("group", degree[0].start, degree[-1].end, parts=degree)] if degree else [])])
        if name in R.ACCENTS:
            inner = self.argument()
            return Node("accent", t.start, inner.end, name, [inner])
        if name in TEXTS or name in R.ALPHABETS:
            inner = self.argument()
            return Node("text", t.start, inner.end, name, [inner])
        if name == "left":
            opening = self.delimiter()
            parts = self.run(("right",))
            if self.peek() is None:
                raise self.fail("left without right", t)
            self.at += 1
            closing = self.delimiter()
            return Node("delimited", t.start, self.tokens[self.at - 1].end, f"{opening} {closing}", parts)
        if name == "begin":
            return self.environment(t)
        if name in R.SILENT:
            return Node("atom", t.start, t.end)
        if name in R.SYMBOLS or name in R.FUNCTIONS:
            return Node("symbol", t.start, t.end, name)
        raise self.fail(f"unsupported command {name}", t)

    def delimiter(self) -> str:
        self.blanks()
        if (t := self.peek()) is None:
            raise self.fail("a delimiter is missing")
        self.at += 1
        return "" if t.text == "." else R.SYMBOLS.get(t.text, t.text)

    def name(self) -> str:
        g = self.argument()
        return self.body[g.start + 1 : g.end - 1].strip() if g.kind == "group" else g.text

    def environment(self, t: Token) -> Node:
        name = self.name()
        if name == "array":
            self.argument()
        rows: list[list[Node]] = [[]]
        while True:
            n = self.peek()
            start = n.start if n else len(self.body)
            cell = self.run(("cell", "row", "end"))
            end = self.peek()
            if end is None:
                raise self.fail(f"unclosed environment {name}", t)
            rows[-1].append(Node("cell", start, end.start, parts=cell))
            self.at += 1
            if end.kind == "row":
                rows.append([])
            elif end.kind == "command":
                break
        if (closed := self.name()) != name:
            raise self.fail(f"environment {name} closed as {closed}", t)
        kept = [r for r in rows if len(r) > 1 or r[0].parts] or rows[:1]
        return Node("environment", t.start, self.tokens[self.at - 1].end, name, [Node("row", r[0].start, r[-1].end, parts=r) for r in kept])


def tree(body: str) -> Node:
    return TreeParser(body).whole()


def walk(node: Node, depth: int = 0) -> Iterator[tuple[Node, int]]:
    yield node, depth
    for p in node.parts:
        yield from walk(p, depth + 1)


def _rows(bodies: DataFrame, function, names: list[str]) -> DataFrame:
    """``bodies(doc_id, text)`` -> rows of (doc_id, kind, s, e, text, n), offsets in bytes of the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                byte = lambda i, t=text or "": len(t[:i].encode())
                rows += [(doc, kind, byte(s), byte(e), what, n) for kind, s, e, what, n in function(text or "")]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "kind", "s", "e", "text", "n"])

    rows = bodies.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, s int, e int, text string, n int")
    return rows.select(*names)


def tokens_of(bodies: DataFrame) -> DataFrame:
    """Tokens of TeX bodies."""
    return _rows(bodies, lambda t: [(x.kind, x.start, x.end, x.text, k) for k, x in enumerate(lex(t))], ["doc_id", "n", "kind", "s", "e", "text"])


def nodes_of(bodies: DataFrame) -> DataFrame:
    """Nodes with their depth; a body that is malformed gives one row of kind ``error`` with the reason."""

    def function(text: str) -> list[tuple]:
        try:
            return [(x.kind, x.start, x.end, x.text, d) for x, d in walk(tree(text))]
        except Malformed as error:
            return [("error", error.start, error.end, str(error), 0)]
        except RecursionError:
            return [("error", 0, len(text), "nested too deeply", 0)]

    return _rows(bodies, function, ["doc_id", "kind", "s", "e", "text", "n"])


def unicode_tokens(text: str) -> list[tuple[str, int, int, str, int]]:
    """(kind, start, end, what it stands for, number): runs of scripts, roots, symbols, letters of an alphabet, accents, the rest."""
    marks = {v: k for k, v in R.ACCENTS.items()}
    out: list[tuple[str, int, int, str, int]] = []

    def kind_of(c: str) -> tuple[str, str]:
        if c in R.UNSUPER:
            return "super", R.UNSUPER[c]
        if c in R.UNSUB:
            return "sub", R.UNSUB[c]
        if c == "√":
            return "root", c
        if c in marks:
            return "accent", marks[c]
        if c in R.COMMANDS:
            return "symbol", R.COMMANDS[c]
        if c in R.FROM_ALPHABET:
            return "alphabet", R.FROM_ALPHABET[c][1]
        return ("space", c) if c.isspace() else ("number", c) if c.isdigit() else ("char", c)

    for i, c in enumerate(text):
        kind, what = kind_of(c)
        if out and out[-1][0] == kind and kind in ("super", "sub", "space", "number", "alphabet"):
            last = out.pop()
            out.append((kind, last[1], i + 1, last[3] + what, last[4]))
        else:
            out.append((kind, i, i + 1, what, len(out)))
    return out


def unicode_tokens_of(texts: DataFrame) -> DataFrame:
    return _rows(texts, unicode_tokens, ["doc_id", "n", "kind", "s", "e", "text"])
