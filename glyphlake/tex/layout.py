"""TeX bodies on a grid of characters around a base line: fractions, roots, scripts, delimiters and matrices."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from glyphlake.functions.text import width_of
from glyphlake.tex import registry as R
from glyphlake.tex.nodes import Malformed, Node, tree

# What stands at the sides of a matrix.
_SIDES = {"pmatrix": "()", "bmatrix": "[]", "vmatrix": "||", "Vmatrix": "‖‖", "Bmatrix": "{}", "cases": "{"}


@dataclass
class Grid:
    lines: list[str]
    base: int = 0

    @property
    def width(self) -> int:
        return max((width_of(x) or 0 for x in self.lines), default=0)


def _padded(text: str, width: int, how: str = "left") -> str:
    gap = width - (width_of(text) or 0)
    left = gap // 2 if how == "center" else 0
    return " " * left + text + " " * (gap - left)


def beside(grids: list[Grid]) -> Grid:
    grids = [g for g in grids if g.width] or [Grid([""])]
    above, below = max(g.base for g in grids), max(len(g.lines) - g.base for g in grids)
    rows = [""] * (above + below)
    for g in grids:
        w = g.width
        for k in range(len(rows)):
            j = k - above + g.base
            rows[k] += _padded(g.lines[j] if 0 <= j < len(g.lines) else "", w)
    return Grid(rows, above)


def _side(c: str, height: int) -> Grid:
    """A delimiter as tall as what it encloses."""
    if not c or height == 1:
        return Grid([c] * height)
    tall = {"(": "⎛⎜⎝", ")": "⎞⎟⎠", "[": "⎡⎢⎣", "]": "⎤⎥⎦", "{": "⎧⎨⎩", "}": "⎫⎬⎭"}.get(c)
    if tall is None:
        return Grid([c] * height)
    middle = ["⎪" if c in "{}" else tall[1]] * (height - 2)
    if c in "{}" and height > 2:
        middle[len(middle) // 2] = tall[1]
    return Grid([tall[0], *middle, tall[2]])


def _scripts(text: str, table: dict[str, str]) -> str | None:
    return "".join(table[c] for c in text) if text and all(c in table for c in text) else None


def draw(n: Node) -> Grid:
    if n.kind in ("body", "group", "cell"):
        return beside([draw(p) for p in n.parts])
    if n.kind == "atom":
        return Grid([n.text])
    if n.kind == "symbol":
        return Grid([R.SYMBOLS.get(n.text, n.text)])
    if n.kind == "text":
        inner = draw(n.parts[0])
        table = R.ALPHABETS.get(n.text, {})
        return Grid(["".join(table.get(c, c) for c in x) for x in inner.lines], inner.base)
    if n.kind == "accent":
        inner = draw(n.parts[0])
        return Grid([*inner.lines[:-1], inner.lines[-1] + R.ACCENTS[n.text]], inner.base) if inner.width <= 1 else Grid(["‾" * inner.width, *inner.lines], inner.base + 1)
    if n.kind == "fraction":
        top, bottom = map(draw, n.parts)
        w = max(top.width, bottom.width, 1)
        bar = [] if n.text == "binom" else ["─" * w]
        lines = [*(_padded(x, w, "center") for x in top.lines), *bar, *(_padded(x, w, "center") for x in bottom.lines)]
        grid = Grid(lines, len(top.lines))
        return beside([_side("(", len(lines)), grid, _side(")", len(lines))]) if n.text == "binom" else grid
    if n.kind == "root":
        inner = draw(n.parts[0])
        degree = draw(n.parts[1]).lines[0] if len(n.parts) > 1 else ""
        degree = _scripts(degree, R.SUPER) or degree
        if len(inner.lines) == 1:
            body = inner.lines[0] if inner.width == 1 else f"({inner.lines[0]})"
            return Grid([f"{degree}√{body}"])
        lines = [" " * (1 + len(degree)) + "_" * inner.width, *(" " * len(degree) + "│" + _padded(x, inner.width) for x in inner.lines)]
        lines[-1] = degree + "√" + lines[-1][1 + len(degree) :]
        return Grid(lines, inner.base + 1)
    if n.kind == "script":
        base, marks = draw(n.parts[0]), dict(zip(n.text.split(), map(draw, n.parts[1:]), strict=True))
        flat = {k: _scripts(g.lines[0], R.SUPER if k == "super" else R.SUB) if len(g.lines) == 1 else None for k, g in marks.items()}
        if all(flat.values()):
            return beside([base, Grid(["".join(flat[k] for k in ("sub", "super") if k in flat)])])
        up, down = marks.get("super", Grid([])), marks.get("sub", Grid([]))
        column = Grid([*up.lines, *[""] * len(base.lines), *down.lines], len(up.lines) + base.base)
        return beside([base, column])
    if n.kind == "delimited":
        inner = beside([draw(p) for p in n.parts])
        left, right = n.text.split(" ") if n.text.strip() else ("", "")
        sides = [_side(c, len(inner.lines)) for c in (left, right)]
        for s in sides:
            s.base = inner.base
        return beside([sides[0], inner, sides[1]])
    if n.kind == "environment":
        rows = [[draw(c) for c in r.parts] for r in n.parts]
        columns = max(map(len, rows))
        wide = [max((r[k].width for r in rows if k < len(r)), default=0) for k in range(columns)]
        lines: list[str] = []
        for r in rows:
            cells = [Grid([_padded(x, w, "center" if "matrix" in n.text else "left") for x in g.lines], g.base) for g, w in zip([*r, *[Grid([""])] * (columns - len(r))], wide, strict=True)]
            whole = [c if k == 0 else beside([Grid(["  "]), c]) for k, c in enumerate(cells)]
            lines += beside(whole).lines
        grid, sides = Grid(lines, (len(lines) - 1) // 2), _SIDES.get(n.text, "")
        for k, c in enumerate(sides):
            side = _side(c, len(lines))
            side.base = grid.base
            grid = beside([side, grid] if k == 0 else [grid, side])
        return grid
    return Grid([""])


def layout(body: str) -> Grid:
    """Raises ``Malformed`` for bodies that cannot be drawn."""
    return draw(tree(body))


_DRAWN = pa.struct([("lines", pa.list_(pa.string())), ("baseline", pa.int32()), ("width", pa.int32()), ("error", pa.string())])


def drawn(body: Column) -> Column:
    """struct<lines, baseline, width, error> of a column of bodies."""

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            g = layout(text)
            return {"lines": g.lines, "baseline": g.base, "width": g.width, "error": None}
        except (Malformed, RecursionError) as error:
            return {"lines": [], "baseline": 0, "width": 0, "error": str(error)}

    @F.arrow_udf("struct<lines:array<string>,baseline:int,width:int,error:string>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in x.to_pylist()], type=_DRAWN)

    return run(body)
