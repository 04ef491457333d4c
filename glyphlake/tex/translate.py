"""TeX bodies to Unicode text and back, with what is lost on the way."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.tex import registry as R

_TOKEN = re.compile(r"\\([A-Za-z]+)|\\(.)|([{}^_&~])|(%[^\n]*)|(\s+)|(.)", re.S)


@dataclass
class Translation:
    text: str
    edits: int = 0
    losses: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "lossy" if self.losses else "lossless" if self.edits else "unchanged"


@dataclass
class Token:
    kind: str  # command, open, close, super, sub, cell, row, space, char
    text: str
    start: int
    end: int


def lex(body: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(body):
        s, e = m.span()
        if m[1]:
            out.append(Token("command", m[1], s, e))
        elif m[2]:
            out.append(Token("row" if m[2] == "\\" else "space" if m[2] in ",;:! " else "char", m[2] if m[2] not in ",;:!" else " " if m[2] != "!" else "", s, e))
        elif m[3]:
            out.append(Token({"{": "open", "}": "close", "^": "super", "_": "sub", "&": "cell", "~": "space"}[m[3]], m[3] if m[3] != "~" else " ", s, e))
        elif m[5]:
            out.append(Token("space", m[5], s, e))
        elif m[6]:
            out.append(Token("char", m[6], s, e))
    return out


class _Kept(Exception):
    """A construct without a Unicode form: its source stays, and the reason is a loss."""


class _Parser:
    """Recursive descent over tokens; emits Unicode directly. White space stays as it is in the source."""

    def __init__(self, body: str):
        self.body, self.tokens, self.at = body, lex(body), 0
        self.out = Translation("")

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def source(self, first: int) -> str:
        """The source of the tokens from number ``first`` to here."""
        return self.body[self.tokens[first].start : self.tokens[self.at - 1].end] if self.at > first else ""

    def skip(self) -> None:
        while (t := self.peek()) and t.kind == "space":
            self.at += 1

    def ends(self, stop: str | None) -> bool:
        t = self.peek()
        return t is None or t.kind == stop or (stop in ("right", "end") and t.kind == "command" and t.text == stop)

    def sequence(self, stop: str | None = None) -> str:
        parts = []
        while not self.ends(stop):
            parts.append(self.node())
        return "".join(parts)

    def group(self) -> str:
        """The inside of one argument: a braced group or a single token."""
        self.skip()
        t = self.peek()
        if t is None:
            raise _Kept("an argument is missing")
        if t.kind != "open":
            return self.base()
        self.at += 1
        inner = self.sequence("close")
        if self.peek() is None:
            raise _Kept("unclosed group")
        self.at += 1
        if "\n" in inner:
            raise _Kept("a body of several lines has no compact form")
        return inner

    def node(self) -> str:
        """One construct with its scripts, or its source if any part of it has no Unicode form."""
        first, losses = self.at, len(self.out.losses)
        try:
            t = self.tokens[first]
            out = "" if t.kind in ("super", "sub") else self.base()
            return out if t.kind == "space" else out + self.scripts()
        except _Kept as reason:
            self.at = max(self.at, first + 1)
            del self.out.losses[losses:]
            self.out.losses.append(str(reason))
            return self.source(first)

    def scripts(self) -> str:
        """The subscript, then the superscript."""
        found = {"sub": "", "super": ""}
        while (t := self.peek()) and t.kind in found and not found[t.kind]:
            self.at += 1
            arg, table = self.group(), R.SUPER if t.kind == "super" else R.SUB
            if not arg or any(c not in table for c in arg):
                self.rest_of_scripts()
                raise _Kept(f"{t.kind}script {arg} has no Unicode form")
            found[t.kind] = "".join(table[c] for c in arg)
        return found["sub"] + found["super"]

    def rest_of_scripts(self) -> None:
        while (t := self.peek()) and t.kind in ("super", "sub"):
            self.at += 1
            self.group()

    def base(self) -> str:
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "open":
            inner = self.sequence("close")
            if self.peek() is None:
                raise _Kept("unclosed group")
            self.at += 1
            return "{" + inner + "}"
        if t.kind == "close":
            raise _Kept("unmatched brace")
        if t.kind in ("super", "sub"):
            raise _Kept("a script follows a script mark")
        if t.kind in ("cell", "row"):
            raise _Kept("cells and rows have no Unicode form")
        return self.command(t) if t.kind == "command" else t.text

    def arguments(self) -> None:
        """Pass over the groups that follow at once."""
        while (t := self.peek()) and t.kind == "open":
            depth = 0
            while t := self.peek():
                depth += (t.kind == "open") - (t.kind == "close")
                self.at += 1
                if not depth:
                    break

    def command(self, t: Token) -> str:
        name = t.text
        if name in R.SYMBOLS:
            if (back := R.COMMANDS.get(R.SYMBOLS[name], name)) != name:
                self.out.losses.append(f"alias {name} comes back as {back}")
            return R.SYMBOLS[name]
        if name in R.FUNCTIONS:
            return name
        if name in R.SILENT:
            return ""
        if name in ("frac", "dfrac", "tfrac", "binom", "overset", "underset", "stackrel"):
            self.group(), self.group()
            raise _Kept(f"{name} has no unambiguous Unicode form")
        if name == "sqrt":
            degree = ""
            if (n := self.peek()) and n.kind == "char" and n.text == "[":
                self.at += 1
                while (n := self.peek()) and n.text != "]":
                    degree += self.node()
                if self.peek() is None:
                    raise _Kept("an unclosed degree")
                self.at += 1
            body = self.group()
            if any(c not in R.SUPER for c in degree):
                raise _Kept("the degree of a root has no superscript form")
            return "".join(R.SUPER[c] for c in degree) + "√" + body
        if name == "left":
            opening = self.delimiter()
            inner = self.sequence("right")
            if self.peek() is None:
                raise _Kept("left without right")
            self.at += 1
            return opening + inner + self.delimiter()
        if name in R.ALPHABETS:
            arg, table = self.group(), R.ALPHABETS[name]
            if any(c not in table for c in arg if not c.isspace()):
                raise _Kept(f"{name} {arg} has no Unicode form")
            return "".join(table.get(c, c) for c in arg)
        if name in R.ACCENTS:
            arg, mark = self.group(), R.ACCENTS[name]
            if sum(not c.isspace() for c in arg) > 1:
                return "{" + arg + "}" + mark
            return "".join(c if c.isspace() else c + mark for c in arg)
        if name in ("text", "mathrm", "mathit", "operatorname", "boldsymbol", "mathop", "textbf", "textit", "textrm"):
            if name == "operatorname" and (n := self.peek()) and n.text == "*":
                self.at += 1
            inner = self.group()
            if name in ("boldsymbol", "textbf", "textit"):
                raise _Kept(f"style {name} has no Unicode form")
            return inner
        if name == "begin":
            self.group()
            self.sequence("end")
            if self.peek():
                self.at += 1
                self.group()
            raise _Kept("an environment has no editable Unicode form")
        self.arguments()
        raise _Kept(f"command {name} is not supported")

    def delimiter(self) -> str:
        self.skip()
        n = self.peek()
        if n is None:
            raise _Kept("a delimiter is missing")
        self.at += 1
        return "" if n.text == "." else R.SYMBOLS.get(n.text, n.text)


def to_unicode(body: str) -> Translation:
    p = _Parser(body)
    p.out.text = p.sequence()
    p.out.edits = int(p.out.text != body)
    return p.out


_PRIMES = {"′": "'", "″": "''", "‴": "'''"}
_CLOSE = {"{": "}", "(": ")", "[": "]"}


def _closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == text[at]) - (text[k] == _CLOSE[text[at]])
        if not depth:
            return k
    return -1


def _atom(text: str, i: int) -> int:
    """End of what a root or an accent stands over: a group, or one character with its scripts."""
    end = _closing(text, i) + 1 if text[i : i + 1] == "{" else i + 1
    end = max(end, min(i + 1, len(text)))
    while end < len(text) and (text[end] in R.UNSUPER or text[end] in R.UNSUB):
        end += 1
    return end


def _inside(text: str) -> str:
    return text[1:-1] if text[:1] == "{" and text[-1:] == "}" else text


def _latex(text: str) -> str:
    marks = {v: k for k, v in R.ACCENTS.items()}
    out, i = [], 0
    while i < len(text):
        c = text[i]
        for table, mark in ((R.UNSUPER, "^"), (R.UNSUB, "_")):
            if c in table:
                j = i
                while j < len(text) and text[j] in table:
                    j += 1
                inner = "".join(table[x] for x in text[i:j])
                if mark == "^" and text[j : j + 1] == "√":
                    end = _atom(text, j + 1)
                    out.append(f"\\sqrt[{inner}]{{{_latex(_inside(text[j + 1 : end]))}}}")
                    j = end
                else:
                    out.append(f"{mark}{{{inner}}}")
                i = j
                break
        else:
            if c == "√":
                end = _atom(text, i + 1)
                out.append(f"\\sqrt{{{_latex(_inside(text[i + 1 : end]))}}}")
                i = end
                continue
            if c in "^_" and i + 1 < len(text) and not text[i + 1].isspace():
                bracket = text[i + 1] in _CLOSE and _closing(text, i + 1)
                if bracket and bracket > 0:
                    out.append(f"{c}{{{_latex(text[i + 2 : bracket])}}}")
                    i = bracket + 1
                    continue
                if text[i + 1] != "\\":
                    out.append(f"{c}{{{_latex(text[i + 1])}}}")
                    i += 2
                    continue
            if c == "{" and (end := _closing(text, i)) > 0 and text[end + 1 : end + 2] in marks:
                out.append(f"\\{marks[text[end + 1]]}{{{_latex(text[i + 1 : end])}}}")
                i = end + 2
                continue
            follow = text[i + 1 : i + 2]
            if c == "\\":  # a command stays
                m = re.match(r"\\(?:[A-Za-z]+|.)?", text[i:], re.S)
                out.append(m[0])
                i += len(m[0])
                continue
            if c in _PRIMES:
                out.append(_PRIMES[c])
            elif follow and follow in marks:
                out.append(f"\\{marks[follow]}{{{_latex(c)}}}")
                i += 1
            elif c in R.COMMANDS:
                apart = follow.isalnum() and follow not in R.UNSUPER and follow not in R.UNSUB and follow not in R.COMMANDS and follow not in R.FROM_ALPHABET
                out.append("\\" + R.COMMANDS[c] + " " * apart)
            elif c in R.FROM_ALPHABET:
                name, j = R.FROM_ALPHABET[c][0], i
                while j < len(text) and R.FROM_ALPHABET.get(text[j], ("",))[0] == name:
                    j += 1
                out.append(f"\\{name}{{{''.join(R.FROM_ALPHABET[x][1] for x in text[i:j])}}}")
                i = j - 1
            else:
                out.append(c)
            i += 1
    return "".join(out)


def to_latex(text: str) -> Translation:
    out = _latex(text)
    return Translation(out, int(out != text))


def events(body: str) -> list[tuple[str, str, int, int, bool]]:
    """(command/enter/exit, name, start, end, in text mode) by tokens only, without a parse."""
    out, tokens, k, texts, depth = [], lex(body), 0, [], 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind == "open":
            depth += 1
        elif t.kind == "close":
            depth -= 1
            if texts and texts[-1] == depth:
                texts.pop()
        elif t.kind == "command":
            if t.text in ("begin", "end") and (m := re.match(r"\s*\{([A-Za-z]+\*?)\}", body[t.end :])):
                out.append(("enter" if t.text == "begin" else "exit", m[1], t.start, t.end + m.end(), bool(texts)))
            else:
                out.append(("command", t.text, t.start, t.end, bool(texts)))
                if t.text in ("text", "mbox", "textrm", "textbf", "textit") and k + 1 < len(tokens) and tokens[k + 1].kind == "open":
                    texts.append(depth)
        k += 1
    return out


_RESULT = "struct<text:string,edit_count:int,losses:array<string>,status:string>"


def translate(body: Column, to: str) -> Column:
    """A struct (text, edit_count, losses, status) for a column of bodies; ``to`` is unicode or latex."""
    convert = to_unicode if to == "unicode" else to_latex

    @F.arrow_udf(_RESULT)
    def run(x: pa.Array) -> pa.Array:
        rows = [convert(t or "") for t in x.to_pylist()]
        return pa.array([{"text": r.text, "edit_count": r.edits, "losses": r.losses, "status": r.status} for r in rows],
                        type=pa.struct([("text", pa.string()), ("edit_count", pa.int32()), ("losses", pa.list_(pa.string())), ("status", pa.string())]))

    return run(body)


def notes(rows: DataFrame) -> DataFrame:
    """``(doc_id, path, x)`` with x a translation -> one line of text for each thing lost."""
    lost = rows.select("doc_id", "path", F.explode("x.losses").alias("loss"))
    return lost.select("doc_id", F.concat("path", F.lit(": note: "), "loss").alias("note"))


def translated_regions(docs: DataFrame, to: str, keep_delimiters: bool = True) -> DataFrame:
    """(doc_id, text, n_regions, losses): the mathematics of each document translated in its place.

    Regions come sorted and do not overlap; bodies are translated row by row and put back in one splice a document.
    """
    from glyphlake.functions import text as T
    from glyphlake.operators.facts import Facts

    facts = Facts(docs, ["math_regions"])
    regions = facts.table("math_regions").where("kind <> 'environment'")
    body = F.col("text") if keep_delimiters else F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = regions.select("doc_id", "s", "e", F.col("n").alias("at"), F.octet_length("text").alias("size"), translate(body, to).alias("x"))
    start, end = (F.col("at"), F.col("at") + F.col("size")) if keep_delimiters else (F.col("s"), F.col("e"))
    edit = F.struct(start.alias("s"), F.lit(0).alias("ord"), end.alias("e"), F.col("x.text").alias("r"))
    edits = rows.groupBy("doc_id").agg(F.collect_list(edit).alias("edits"), F.flatten(F.collect_list("x.losses")).alias("losses"))
    none = F.expr("cast(array() as array<struct<s:int,ord:int,e:int,r:string>>)")
    out = facts.docs.join(edits, "doc_id", "left").withColumn("edits", F.coalesce(T.greedy_from_the_end(F.col("edits")), none))
    return out.select("doc_id", T.splice(F.col("text"), F.col("edits")).alias("text"), F.size("edits").alias("n_regions"), F.coalesce(F.array_sort("losses"), F.expr("cast(array() as array<string>)")).alias("losses"))


def previewed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): mathematics as plain Unicode without its delimiters, for a terminal."""
    return translated_regions(docs, "unicode", keep_delimiters=False).select("doc_id", "text")
