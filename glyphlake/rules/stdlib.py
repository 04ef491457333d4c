"""The standard rules. A rule maps ``Facts`` to rows (doc_id, s, e, message, replacement, safe)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts, at_home
from glyphlake.operators.ranges import outside, under_heading
from glyphlake.tex import registry
from glyphlake.tex.render import Profile, issues

Check = Callable[[Facts], DataFrame]


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    check: Check
    description: str
    default: bool = True
    advisory: bool = False
    fixes: str = ""  # safe, unsafe or none
    marks: str | None = None  # of these a run of prose holds one if the rule finds anything in it; None: not known


RULES: dict[str, Rule] = {}


def rule(name: str, needs: str, description: str, **flags) -> Callable[[Check], Check]:
    def add(check: Check) -> Check:
        RULES[name] = Rule(name, tuple(needs.split()), check, description, **flags)
        return check

    return add


def found(rows: DataFrame, s: Column | str, e: Column | str, message: Column | str, replacement: Column | None = None, safe: bool = False) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    text = F.lit(message) if isinstance(message, str) else message
    fix = F.lit(None).cast("string") if replacement is None else replacement
    return rows.select("doc_id", col(s).cast("int").alias("s"), col(e).cast("int").alias("e"), text.alias("message"), fix.alias("replacement"), F.lit(safe).alias("safe"))


def in_text(facts: Facts, table: str, pattern: str) -> DataFrame:
    """Every match of a pattern in a text fact: (doc_id, s, e, m) in bytes of the document."""
    rows = facts.table(table).where(F.col("text").rlike(pattern))
    hits = rows.select("doc_id", F.col("s").alias("at"), F.explode(T.matches(F.col("text"), pattern)).alias("x"))
    return hits.select("doc_id", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"), F.col("x.m").alias("m"))


@rule("unbalanced-backtick", "prose", "A backtick that opens no code span", marks="`")
def unbalanced_backtick(facts: Facts) -> DataFrame:
    hits = in_text(facts, "prose", r"\\*`")
    return found(hits.where(F.length("m") % 2 == 1), F.col("e") - 1, "e", "unpaired backtick")


@rule("math/unbalanced-delim", "math_errors", "A math delimiter without its partner")
def math_delim(facts: Facts) -> DataFrame:
    return found(facts.table("math_errors").where("kind = 'delim'"), "s", "e", F.concat(F.lit("unmatched "), "text"))


@rule("math/unbalanced-env", "math_errors", "A math environment that is not closed")
def math_env(facts: Facts) -> DataFrame:
    return found(facts.table("math_errors").where("kind = 'env'"), "s", "e", F.concat(F.lit("unmatched environment "), "text"))


@rule("math/unbalanced-braces", "math_errors", "Braces that do not match in mathematics")
def math_braces(facts: Facts) -> DataFrame:
    return found(facts.table("math_errors").where("kind = 'braces'"), "s", "e", "unbalanced braces")


@rule("math/render-compat", "math_regions", "A command that the renderer does not know", default=False)
def render_compat(facts: Facts, profile: Profile | None = None) -> DataFrame:
    return found(issues(facts.table("math_regions"), profile), "s", "e", F.concat_ws(": ", "code", "name"))


@rule("adjacent-code-no-space", "inline_codes", "Code that touches a word", fixes="safe")
def adjacent_code(facts: Facts) -> DataFrame:
    rows, before, after = facts.table("inline_codes"), F.col("kind"), F.col("label")
    sides = F.array(
        F.when(before.rlike("^[A-Za-z]$"), F.struct(F.col("s").alias("at"), F.lit("before").alias("side"))),
        F.when(after.rlike("^[A-Za-z]") & ~after.rlike("^'?s(?:[^A-Za-z]|$)"), F.struct(F.col("e").alias("at"), F.lit("after").alias("side"))),
    )
    rows = rows.select("doc_id", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
    return found(rows, "x.at", "x.at", F.concat(F.lit("no space "), "x.side", F.lit(" code")), F.lit(" "), True)


@rule("heading-punctuation", "headings", "A heading that ends in a full stop or colon", fixes="safe")
def heading_punctuation(facts: Facts) -> DataFrame:
    return found(facts.table("headings").where(F.col("text").rlike("[.:]$")), F.col("e") - 1, "e", F.concat(F.lit("heading ends in "), F.right("text", F.lit(1))), F.lit(""), True)


@rule("orphan-reference-link", "prose link_defs", "A reference link without a definition", marks="[")
def orphan_reference(facts: Facts) -> DataFrame:
    hits = in_text(facts, "prose", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]")
    label = F.coalesce(F.nullif(F.regexp_extract("m", r"\]\[(.*)\]$", 1), F.lit("")), F.regexp_extract("m", r"^\[(.*?)\]\[", 1))
    defs = facts.table("link_defs").select(F.col("doc_id").alias("_d"), F.col("label").alias("_l"))
    hits = hits.withColumn("label", T.normal_label(label))
    return found(hits.join(defs, (F.col("doc_id") == F.col("_d")) & (F.col("label") == F.col("_l")), "left_anti"), "s", "e", F.concat(F.lit("no definition of "), "label"))


@rule("duplicate-link-label", "link_defs", "A label that is defined again")
def duplicate_label(facts: Facts) -> DataFrame:
    again = F.row_number().over(W.partitionBy("doc_id", "label").orderBy("s"))
    return found(facts.table("link_defs").withColumn("k", again).where("k > 1"), "s", "e", F.concat(F.lit("label defined before: "), "label"))


@rule("bare-url", "prose autolinks link_like", "A URL without angle brackets", fixes="safe", marks=":")
def bare_url(facts: Facts) -> DataFrame:
    seen = facts.table("autolinks").where((F.col("kind") == "GfmUrl") & F.lower("text").rlike("^https?://")).select("doc_id", "s", "e", F.col("text").alias("m"))
    raw = in_text(facts, "prose", r"https?://[^\s<>\[\]()]+").withColumn("m", T.trim_punctuation(F.col("m")))
    raw = raw.withColumn("e", F.col("s") + F.octet_length("m"))
    both = seen.unionByName(raw.select("doc_id", "s", "e", "m")).groupBy("doc_id", "s").agg(F.min(F.struct("e", "m")).alias("x")).select("doc_id", "s", "x.e", "x.m")
    return found(outside(both, at_home(facts.table("link_like"))), "s", "e", F.concat(F.lit("bare URL "), "m"), F.concat(F.lit("<"), "m", F.lit(">")), True)


@rule("trailing-whitespace", "blank_ends code_blocks", "Blanks at the end of a line", fixes="safe")
def trailing_whitespace(facts: Facts) -> DataFrame:
    rows = facts.table("blank_ends").where(~((F.col("text") == "  ") & (F.col("n") > 2)))
    return found(outside(rows.select("doc_id", "s", "e"), at_home(facts.table("code_blocks")), "start"), "s", "e", "trailing blanks", F.lit(""), True)


@rule("inconsistent-list-marker", "list_items list_groups", "Neighbouring bullet lists with different markers", fixes="safe")
def inconsistent_marker(facts: Facts) -> DataFrame:
    group = facts.table("list_groups").where("kind = 'bullet'").select("doc_id", "label", F.col("s").alias("gs"), F.col("e").alias("ge"))
    items = facts.table("list_items").where("kind = 'bullet'").join(group, ["doc_id", "label"])
    first = items.where("n = 0").select("doc_id", "label", "gs", "ge", F.col("text").alias("marker"))
    near = W.partitionBy("doc_id").orderBy("gs")
    islands = first.withColumn("new", F.when(F.col("gs") - F.lag("ge").over(near) <= 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(near))
    lead = islands.withColumn("want", F.first("marker").over(W.partitionBy("doc_id", "island").orderBy("gs"))).select("doc_id", "label", "want")
    rows = items.join(lead, ["doc_id", "label"]).where("text <> want")
    return found(rows, "s", "e", F.concat(F.lit("marker differs from "), "want"), F.col("want"), True)


@rule("table-pipe-spacing", "tables table_cells", "A pipe that touches the text of a cell in an aligned table", fixes="safe")
def pipe_spacing(facts: Facts) -> DataFrame:
    tables = facts.table("tables").where(F.col("text").rlike("left|right|center")).select("doc_id", F.col("s").alias("ts"), F.col("e").alias("te"))
    cells = facts.table("table_cells").where("n <> 1 and text <> ''").select("doc_id", "s", "e", "kind")
    rows = cells.join(tables, "doc_id").where("s >= ts and e <= te")
    spots = F.array(F.when(F.left("kind", F.lit(1)) == "|", F.col("s")), F.when(F.right("kind", F.lit(1)) == "|", F.col("e")))
    spots = rows.select("doc_id", F.explode(F.filter(spots, lambda x: x.isNotNull())).alias("at"))
    return found(spots, "at", "at", "no space at pipe", F.lit(" "), True)


@rule("list-tightness-flipped", "list_groups list_items", "A list that looks tight and is loose, or the other way", default=False, advisory=True)
def tightness(facts: Facts) -> DataFrame:
    items = facts.table("list_items").select("doc_id", "label", "s", F.lead("s").over(W.partitionBy("doc_id", "label").orderBy("s")).alias("next"))
    items = items.join(at_home(facts.docs), "doc_id").withColumn("gap", F.when(F.col("next").isNotNull(), T.bytes_of(F.col("text"), F.col("s"), F.col("next"))).otherwise(""))
    seen = items.groupBy("doc_id", "label").agg(F.bool_or(F.col("gap").rlike(r"\n[ \t\r]*\n")).alias("apart"))
    groups = facts.table("list_groups").join(seen, ["doc_id", "label"]).where((F.col("text") == "loose") != F.col("apart"))
    return found(groups, "s", "e", F.concat(F.lit("list reads as "), "text"))


@rule("duplicate-heading", "headings", "A heading that repeats one under the same parent", advisory=True)
def duplicate_heading(facts: Facts) -> DataFrame:
    rows = under_heading(facts.table("headings").select("doc_id", "s", "e", "text", F.col("n").alias("level"))).withColumn("low", F.lower("text"))
    again = F.row_number().over(W.partitionBy("doc_id", "level", "parent", "low").orderBy("s"))
    return found(rows.withColumn("k", again).where("k > 1"), "s", "e", F.concat(F.lit("heading repeats: "), "text"))


_SCRIPTS = {"^{-1}": "⁻¹", "^{n}": "ⁿ", "_{n}": "ₙ", "^{i}": "ⁱ", "_{i}": "ᵢ"}
_SCRIPTS |= {f"^{{{d}}}": "⁰¹²³⁴⁵⁶⁷⁸⁹"[d] for d in range(10)} | {f"_{{{d}}}": "₀₁₂₃₄₅₆₇₈₉"[d] for d in range(10)} | {f"^{{-{d}}}": "⁻" + "⁰¹²³⁴⁵⁶⁷⁸⁹"[d] for d in range(10)}


def lookup(keys: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), keys)


@rule("unicodeable-subscript", "prose math_regions", "A script that Unicode can write", advisory=True, fixes="safe", marks="{")
def unicode_script(facts: Facts) -> DataFrame:
    hits = outside(in_text(facts, "prose", r"[\^_]\{(?:-?[0-9]|n|i)\}"), at_home(facts.table("math_regions")), "inside").withColumn("new", lookup(F.col("m"), _SCRIPTS))
    return found(hits.where("new is not null"), "s", "e", F.concat(F.lit("write "), "new"), F.col("new"), True)


LANGUAGES = (
    "bash sh shell zsh fish console text txt plain plaintext python py python3 pycon ipython rust rs toml yaml yml json json5 jsonc jsonl xml html css scss less javascript js jsx "
    "typescript ts tsx c h cpp c++ cc hpp csharp cs java kotlin scala go ruby rb perl php swift objc r julia jl matlab octave haskell hs ocaml ml lean lean4 coq agda elixir erlang "
    "clojure lisp scheme lua sql graphql proto protobuf dockerfile docker makefile make cmake nix ini cfg conf diff patch markdown md mdx rst tex latex bibtex mermaid dot graphviz "
    "vim powershell ps1 bat awk sed asm wasm regex http csv tsv zig dart"
).split()


@rule("info-string-typo", "code_blocks", "A code language nobody knows", advisory=True)
def info_string(facts: Facts, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = facts.table("code_blocks").where("kind = 'fenced' and label <> ''").withColumn("lang", F.split("label", "[, \t]")[0])
    known = rows.sparkSession.createDataFrame([(x,) for x in sorted({*LANGUAGES, *extra})], "known string")
    rows = rows.where(~F.col("lang").rlike(r"^\{.*\}$")).withColumn("low", T.ascii_lower(F.col("lang")))
    rows = rows.join(F.broadcast(known), F.col("low") == F.col("known"), "left_anti")
    return found(rows, "s", F.col("s") + F.col("n"), F.concat(F.lit("unknown language "), "lang"))


@rule("stray-dollar", "prose", "A dollar sign in prose", default=False, fixes="unsafe", marks="$")
def stray_dollar(facts: Facts) -> DataFrame:
    return found(in_text(facts, "prose", r"\$"), "s", "e", "dollar sign", F.lit(r"\$"))


@rule("latex-command", "prose math_regions", "A TeX command outside mathematics", default=False, fixes="safe", marks="\\")
def latex_command(facts: Facts) -> DataFrame:
    hits = outside(in_text(facts, "prose", r"\\[A-Za-z]+(?:\{[^{}\n]*\})?"), at_home(facts.table("math_regions")), "inside")
    hits = hits.where(~F.col("m").rlike(r"^\\(?:begin|end)\{"))
    symbols = hits.sparkSession.createDataFrame([(rf"\{name}", char) for name, char in registry.SYMBOLS.items()], "command string, symbol string")
    hits = hits.join(F.broadcast(symbols), F.col("m") == F.col("command"), "left")
    return found(hits, "s", "e", F.concat(F.lit("command "), "m"), F.col("symbol"), True)


@rule("escaped-emphasis", "prose", "An escaped emphasis mark", default=False, fixes="safe", marks="\\")
def escaped_emphasis(facts: Facts) -> DataFrame:
    return found(in_text(facts, "prose", r"\\[_*`]"), "s", "e", F.concat(F.lit("escape "), "m"), F.substring("m", 2, 1), True)


_HEADS = ["f", "g", "φ", "ψ", "π", "ι", "i", "j", "p", "q"]


@rule("subscript-damage", "prose inline_codes", "An asterisk that was a subscript", default=False, fixes="unsafe", marks="*")
def subscript_damage(facts: Facts) -> DataFrame:
    pattern = r"[A-Za-z\p{IsGreek}\p{L}]\*[A-Za-z{]"
    code = facts.table("inline_codes").withColumn("s", F.col("s") + F.length(F.regexp_extract(F.lit("`"), "(`+)", 1)))
    inside = code.where(F.col("text").rlike(pattern)).select("doc_id", F.col("s").alias("at"), F.explode(T.matches(F.col("text"), pattern)).alias("x"))
    inside = inside.select("doc_id", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"), F.col("x.m").alias("m"))
    hits = in_text(facts, "prose", pattern).unionByName(inside).where(~F.substring("m", 1, 1).isin(_HEADS))
    return found(hits, "s", "e", F.concat(F.lit("asterisk in "), "m"), F.regexp_replace("m", r"\*", "_"))
